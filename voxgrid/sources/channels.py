"""Collecting channels as a Python data source, their registry, and a generator of demo posts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POST_SCHEMA = "post_seq long, id string, platform string, keyword string, title string, content string, url string, likes long"
RUN_SCHEMA = "channel_id string, ok boolean, error string, posts long"
_TONES = (("很好用，推荐", 0.4), ("有点失望，卡顿", 0.35), ("还可以，一般", 0.25))


class DemoSource(DataSource):
    """Made-up posts, the same for the same options: keywords (comma list), posts (per keyword and platform)."""

    PLATFORMS = ("weibo", "bilibili", "xiaohongshu", "websearch")

    @classmethod
    def name(cls) -> str:
        return "voxgrid_demo"

    def schema(self) -> str:
        return POST_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _DemoReader([k for k in self.options.get("keywords", "demo").split(",") if k], int(self.options.get("posts", "2")))


class _DemoReader(DataSourceReader):
    def __init__(self, keywords: list[str], posts: int):
        self.keywords, self.posts = keywords, posts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, k)) for i, k in enumerate(self.keywords)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import zlib

        i, keyword = partition.value
        for j, platform in enumerate(DemoSource.PLATFORMS):
            for n in range(self.posts):
                u = zlib.crc32(f"42/{keyword}/{platform}/{n}".encode()) / 2**32
                at, tone = 0.0, _TONES[-1][0]
                for text, share in _TONES:
                    at += share
                    if u < at:
                        tone = text
                        break
                seq = (i * len(DemoSource.PLATFORMS) + j) * self.posts + n
                yield seq, f"demo{seq}", platform, keyword, f"{keyword}体验", f"{keyword}{tone}", f"https://demo.example/{seq}", int(u * 100)


#: Channel ids in their order; unknown ids are an error, unlisted ones sort last.
REGISTRY: dict[str, type[DataSource]] = {"demo": DemoSource}
ORDER = ("demo", "bilibili", "websearch", "websearch_zhihu", "websearch_tieba", "websearch_taptap", "weibo", "xiaohongshu")


def source(channel: str) -> type[DataSource]:
    """The data source of a channel; KeyError for an unknown one."""
    return REGISTRY[channel]


def ordered(df: DataFrame, channel: str = "channel_id") -> DataFrame:
    """Channels in their fixed order, others last by name."""
    place = F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col(channel))
    return df.withColumn("ord", F.when(place > 0, place).otherwise(99)).orderBy("ord", channel)


def collect(spark: SparkSession, channels: list[str], **options: str) -> tuple[DataFrame, DataFrame]:
    """Posts of all channels and a row per channel with how it went; a channel that fails gives no posts and a failed row."""
    posts = spark.createDataFrame([], POST_SCHEMA)
    runs = []
    for c in channels:
        try:
            src = source(c)
            spark.dataSource.register(src)
            reader = spark.read.format(src.name())
            for k, v in options.items():
                reader = reader.option(k, v)
            got = reader.load()
            runs.append((c, True, None, got.count()))
            posts = posts.unionByName(got)
        except Exception as e:  # any failure of a source degrades to an empty result
            runs.append((c, False, f"{type(e).__name__}: {e}"[:200], 0))
    return posts, spark.createDataFrame(runs, RUN_SCHEMA)
