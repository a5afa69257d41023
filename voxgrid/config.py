"""Thresholds and small resource tables. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

SENTIMENTS = ("positive", "negative", "neutral")
UNKNOWN_DATE, UNSORTED = "未知", "未分类"

# Limits and thresholds that results depend on.
KEY_PREFIX, BODY_KEY_LEAST = 50, 20
SHORT_WEB, SHORT_OTHER, BOILERPLATE_EXEMPT = 5, 10, 10
LOW_CONFIDENCE, LOW_CONFIDENCE_CAP = 0.6, 50
LCS_HAN, LCS_LATIN, LCS_SIGNAL = 2, 3, 4
NEUTRAL_BAND, STRONG_WEIGHT, HIT_UNIT, NEGATED, TANH_SCALE = 0.15, 1.2, 0.5, 0.8, 3.0
CONFIDENCE_GAIN, NO_HIT_CAP, IRONY_CAP, LEAN_CAP = 2.5, 0.2, 0.3, 0.3
WORD_LONGEST, LOOKBACK = 8, 2
ROUTE_UNDER, REVIEW_V1, REVIEW_V2, DISPLAY_CAP = 0.8, 0.5, 0.7, 0.6
N_RATED, N_NORMAL = 3, 10
EVIDENCE_LENGTH, FINDINGS_MOST = 80, 5
COOC_WINDOW, COOC_TOP, COOC_LEAST, GRAPH_NODES, GRAPH_EDGES = 3, 30, 3, 20, 20
CLUSTERS_MOST, CLUSTER_TOTAL, CLUSTER_EDGES, CLUSTER_NODES = 5, 20, 12, 15
PHRASE_LEAST, PHRASE_PMI, PHRASE_PMI_RELAXED, PHRASE_TOP, PHRASE_LONGEST = 2, 1.5, 1.2, 50, 40
SOURCE_LEAST, SOURCE_TOP = 5, 12
CLOUD_STRONG, CLOUD_WEAK, CLOUD_CAP = 0.25, 0.1, 20
LABEL_BAND = 0.15
VOICE_ENOUGH, VOICE_SOME = 0.6, 0.3
TOPUP_RATE, TOPUP_ROUNDS, TOPUP_YIELD, TOPUP_RATIO = 0.15, 3, 3, 0.2
NARRATIVE_REFERENCE = 10
WEEKLY_SPAN, TREND_BAND = 90, 0.05
EVAL_REFERENCE, FLAT_BAND, Z, SHORT_BOARD = 30, 1.0, 1.96, 0.75
STRONG_N, STRONG_RATE, WEAK_N, WEAK_RATE = 30, 0.5, 10, 0.4
COOLDOWN_BASE, COOLDOWN_MOST = 10, 60
STALE_TASK_S, ACTIVE_WORKER_S = 90, 60
PRICE_IN, PRICE_OUT = 2.0, 8.0

#: Small lexicon of our own: word and score; factors of degree words; negations; words whose parts don't count.
LEXICON = {
    "好用": 1.0, "流畅": 1.0, "惊喜": 1.2, "精致": 1.0, "耐看": 0.8, "实惠": 0.8, "踏实": 0.8, "推荐": 1.2, "清晰": 0.8, "顺手": 0.8, "稳定": 0.8, "贴心": 1.0,
    "舒服": 1.0, "靠谱": 1.0, "惊艳": 1.2, "喜欢": 1.0, "满意": 1.2, "好看": 0.8, "划算": 0.8, "真香": 1.0, "great": 1.0, "smooth": 0.8, "solid": 0.8, "crisp": 0.8, "comfy": 0.8, "neat": 0.8, "reliable": 1.0, "fun": 0.8,
    "失望": -1.2, "卡顿": -1.0, "粗糙": -1.0, "鸡肋": -1.0, "后悔": -1.2, "模糊": -0.8, "别扭": -0.8, "敷衍": -1.0, "闪退": -1.2, "平庸": -0.6, "廉价": -0.8, "翻车": -1.2,
    "拉胯": -1.2, "坑人": -1.2, "糟心": -1.2, "吵闹": -0.8, "离谱": -0.8, "劝退": -1.0, "awful": -1.2, "laggy": -1.0, "flimsy": -1.0, "boring": -0.8, "noisy": -0.8, "broken": -1.2, "useless": -1.2, "rude": -1.0,
}
DEGREES = {"非常": 1.5, "特别": 1.5, "太": 1.4, "很": 1.2, "挺": 1.1, "更": 1.1, "有点": 0.7, "略": 0.7, "so": 1.3}
NEGATIONS = ("不", "没", "别", "无", "未")
CONTEXT_WORDS = ("不卡顿测试", "看好用户")
STRONG_NEGATIVE = ("坑人", "糟心", "useless")
IRONY = ("呵呵", "真是服了", "好家伙", "笑死", "可真行")
STOPWORDS = ("我们", "你们", "他们", "这个", "那个", "就是", "还是", "没有", "什么", "一个", "the", "and", "for", "with", "this", "that", "was", "are", "you")
AD_MARKERS = ("优惠券", "下单链接", "团购", "代购", "满减", "促销", "包邮", "加微信", "coupon", "discount", "promo code", "affiliate", "sponsored", "free shipping")
BOILERPLATE = ("版权所有", "icp备", "免责声明", "点击进入", "返回首页", "all rights reserved", "cookie policy", "terms of service", "privacy policy")
OFFICIAL_WORDS, SITE_WORDS, REVIEW_SITE_WORDS = ("官方旗舰店", "官方网站"), ("官网", "首页"), ("测评", "评测", "点评", "论坛")
PROFANITY = ("傻瓜", "混蛋", "idiot", "stupid")
RISK_MARKERS, HARD_RISK = ("访问过于频繁", "请完成验证", "验证码", "captcha", "too many requests"), ("账号异常", "封禁", "forbidden")
ERROR_CLASSES = (
    ("network", r"timed? ?out|connection|dns|网络|超时"), ("auth", r"401|403|cookie|login|登录|权限"), ("quota", r"quota|rate limit|too many|额度|频繁"),
    ("risk", r"captcha|verify|验证|风控"), ("llm", r"model|token|api key|大模型"), ("parse", r"json|parse|decode|解析"), ("storage", r"disk|sqlite|permission|磁盘"),
)
FIXES = {"network": "check the connection and retry", "auth": "sign in again", "quota": "wait for the quota to reset", "risk": "slow down and verify", "llm": "check the key of the model", "parse": "report the response", "storage": "free some space", "unknown": "see the log"}
SYNONYM_TOPICS = {"性能": ("卡顿", "流畅", "延迟"), "外观": ("精致", "粗糙", "好看"), "价格": ("实惠", "划算", "廉价")}
#: Aliases of aspects, polarity order of ties, frames and actors of narratives.
POLARITY_ORDER = ("negative", "positive", "neutral")
FRAMES = ("conflict", "economic", "human_interest", "morality", "responsibility")
ACTORS = ("企业", "个人", "平台", "政府", "媒体", "技术", "行业", "不明确")
