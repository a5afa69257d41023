"""A small labelled table of private data in text: frames with marked slots, and rules that fill them.

{E} email address, {P} phone number, {I} identity number, {A} address, {N} name of a private person;
{x}, {c}, {k}, {w} and {d} are unlabelled: order-like number, model code, product, ordinary word, small number.

Frames are everyday sentences about schools, clinics, landlords, banks and travel. Names of places, streets, hosts
and products are put together from syllables and characters, so that what is learned is the shape and the company
of private data, not a list of them. HELD_OUT are frames that training never sees.
"""

from __future__ import annotations

import random

#: Common family names, and characters that given names are often made of.
SURNAMES = (
    "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 郭 何 林 高 罗 郑 梁 谢 宋 唐 许 韩 冯 邓 曹 彭 曾 肖 田 董 袁 潘 于 蒋 蔡 余 杜 叶 程 苏 魏 吕 丁 任 沈 "
    "姚 卢 姜 崔 钟 谭 陆 汪 范 金 石 廖 贾 夏 韦 付 方 白 邹 孟 熊 秦 邱 江 尹 薛 闫 段 雷 侯 龙 史 陶 黎 贺 顾 毛 郝 龚 邵 万 钱 严 覃 武 戴 莫 孔 向 汤 "
    "柏 水 窦 章 云 葛 奚 鲁 昌 苗 凤 花 俞 柳 费 廉 岑 滕 殷 毕 安 常 乐 傅 齐 康 伍 元 卜 穆 萧 湛 米 贝 明 臧 计 成 谈 庞 纪 舒 屈 项 祝 梅 盛 刁 "
    "喻 华 卫 施 尤 戚 褚 阮 蓝 闵 席 季 麻 强 路 娄 危 童 应 宗 丰 邢 裴 祖 焦 牧 隗 山 谷 车 宓 蓬 全 班 仰 秋 仲 伊 宫 宁 仇 甘 欧阳 司徒 诸葛 上官 司马 东方 夏侯 皇甫 尉迟 公孙 慕容 令狐 长孙 宇文 端木"
).split()
GIVEN = (
    "伟芳娜敏静秀丽强磊洋艳勇军杰娟涛超明霞平刚桂英玉兰文辉红梅建国华志春晓燕佳琪雨欣梓涵子轩浩然思怡诗语宇博睿泽楠一诺沐澄舟瑾晏遥景川亦清昱辰听霖绍知歆恒岑婧初尘墨言安宁远行之凡可心悦彤若曦柔瑶澜怀"
    "俊鹏飞斌波峰凯健翔彬毅晨阳光亮天龙成荣海山林森松柏云雷雪冰莹珊珍珠琳琴琼璐瑞祥福贵德义礼信忠孝仁正直诚敬谦和乐康宝全有才学智慧贤良善美好婷媛嫣妍娇婉淑慧颖颜蓉莲菊荷茜萍蕾薇芸芝芬芹苗茹菲晴岚虹霜露月星辰夏秋冬东南西北"
)
FIRST = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Donald Sandra "
    "Steven Ashley Paul Kimberly Andrew Emily Joshua Donna Kenneth Michelle Kevin Carol Brian Amanda George Dorothy Edward Melissa Ronald Deborah Timothy Stephanie Jason Rebecca Ryan Sharon Nora Felix Clara Otto Ingrid Bruno"
).split()
LAST = (
    "Smith Johnson Williams Brown Jones Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Martin Lee Perez White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King "
    "Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts"
).split()
#: Syllables for family names, streets, brands and hosts that no list holds, and characters for places.
HEADS = "ba bel bro cal car cor dan del dor fal fen gar gil hal har kel ken lan lor mar mel mor nor pan per ran rol san sel sor tal tan tor val var vel wal wil win"
TAILS = "by den dale don ford field ham hurst ker ley lin low man mont more nell ner ran rick ridge son stead ster stone ton vale wick wood worth"
PLACE = "东西南北中上下新老大小长青白红金银石松柳梅兰桂竹荷云霞月星山水溪江河湖海泉桥塘井岭坡台城门关安宁和平兴隆福寿文明永泰丰庆祥瑞春秋阳光华景秀丽芳香"
ROADS_EN = "Abbey Acorn Ash Bank Beech Birch Bridge Canal Castle Cedar Cherry College Cross Dove Elm Ferry Forest Grange Grove Hazel High Holly Kings Lake Laurel Linden London Long Market Meadow North Orchard Park Pine Poplar Queen River Rose School South Spring Sycamore Tower Union Walnut Water West Willow York"
EN_KIND = "Road Street Lane Avenue Close Court Drive Ave St Rd Ave. St. Way Place Terrace Hill Crescent Boulevard Blvd Square Row Gardens Grove Walk Falls"
NOUNS = "Desk Mug Kettle Camera Lamp Chair Bottle Jacket Sofa Router Phone Tablet Speaker Tent Bike Cream Tea Coffee Knife Pan Shoes Bag Watch Game Quest Legends Saga World Arena Pro Max Mini Plus Air"
NOUNS_ZH = "书桌 马克杯 水壶 相机 椅子 外套 沙发 手机 平板 帐篷 单车 面霜 茶叶 咖啡 菜刀 炒锅 跑鞋 挎包 路由器 游戏 传说 物语 之城 耳麦 冰箱 牙刷 毛巾 雨衣 充电宝 扫地机 电动车 自行车 婴儿车 玩具车 文具 花瓶 石锅 金表 白酒 方巾 温度计 收纳盒 台历"

#: Ordinary words that begin with a family name's character.
WORDS = (
    "廉价 毕业 安静 明显 高端 白色 金属 石头 方便 万一 夏天 秋天 常用 花纹 成品 计时 云朵 水润 马上 何时 江湖 任务 田园 史诗 龙年 钱包 严重 孔洞 向上 汤色 "
    "柏油 章节 乐趣 齐全 康复 元旦 和平 明亮 成熟 谈价 纪念 舒服 项目 盛夏 华丽 施工 时间 强烈 路由器 童年 应该 宗旨 山水 谷物 车载 全新 班级 秋冬 宫廷 宁静 "
    "蓝色 席位 季节 麻烦 危险 丰富 祖传 焦虑 侯门 温和 温柔 易坏 段位 雷声 贺卡 顾客 毛躁 钟声 程度 苏打 叶子 余量 杜绝 彭湃 曾经 董事 许多 韩式 唐装 高级 罗列 "
    "林间 何必 郭外 胡乱 朱红 马力 孙子 徐徐 周边 吴侬 赵宋 黄金 杨桃 陈旧 刘海 张力 李子 王者 贝壳 米饭 卜算 伍仟 祝福 梅花 费力 安装 安全 水洗 石英 方向 常见 成色 明年 金色 花香 白天 高温 "
    "全家 全国 全部 路上 路过 路边 山顶 水瓶 水果 水平 车位 车费 强迫 应付 成本 成绩 成功 安心 安排 安慰 乐器 常年 常识 康健 元素 元气 明白 明细 计划 计算 花钱 花费 云端 章程 方案 方式 白天 白送 石板 金额 金币 "
    "万分 万能 高兴 高度 高铁 马路 马桶 黄色 黄油 林子 周末 周一 周年 徐缓 许久 何况 何苦 余下 余额 叶片 程序 任何 任性 沈静 钟表 江边 龙头 史上 毛病 毛衣 钱币 严格 武器 武侠 戴上 莫名 向来 汤勺 温度 温馨 温水 游戏 游客 丁点 易碎 易用"
).split()

FRAMES = """
联系{N}
联系人{N}
找{N}
我叫{N}
本人{N}
我是{N}
姓名{N}
姓名：{N}
名字：{N}
收件人：{N}
收货人{N}
寄件人{N}
转交{N}
转交{N}女士
转交{N}先生
交给{N}女士
留给{N}
谢谢{N}
感谢{N}
麻烦{N}代收
{N}女士您好
{N}先生
{N}老师
{N}同学
{N}你好
{N}，在吗
师傅{N}
店员{N}
店长{N}
骑手{N}
司机{N}
客服{N}
保安{N}
房东{N}
中介{N}
导购{N}
老板{N}
物业{N}说下午来
物业的{N}
邻居{N}把钥匙留下了
邻居{N}
楼上的{N}
隔壁的{N}
店里{N}
前台{N}登记的
班主任{N}打来问作业
班主任{N}
放射科{N}医生看得仔细
挂{N}医生的专家号
户主{N}
户主一栏是{N}
签字人{N}
经办{N}
署名{N}
落款是{N}
写着{N}三字
印着{N}
登记成{N}了
名叫{N}
叫{N}的人
叫做{N}
昨天{N}来过
跟{N}说一声
多亏{N}
委托{N}办理过户
借款人{N}
报名人{N}，电话{P}
患者{N}，身份证{I}
租客{N}已经搬走
帮{N}带一份
教练{N}教得耐心
护士{N}
{N}帮我修好的
{N}回电
{N}修的
{N}，他能
{N}答应了
{N}，不是我
给{N}
请{N}
是{N}
由{N}
{E}
联系{E}
邮箱{E}
邮箱：{E}
发到{E}
寄到{E}
简历投递 {E} 即可
写信给{E}
把合同扫描件传到{E}
{E} 收不到验证信
账号是{E}
抄送{E}
报名表请回复 {E}
退信：{E}
{E}，谢谢
{P}
电话{P}
电话：{P}
手机{P}
手机号 {P}
号码{P}
微信同号{P}
微信{P}
拨打{P}
打{P}
租房找我{P}
家教预约{P}
紧急联系人{P}
传真{P}
{P}，晚上再打
{P} 一直占线
加{P}
短信发到{P}了
座机{P}
{P}是空号
身份证{I}
身份证号{I}
身份证号码：{I}
证件{I}
证件号：{I}
护照{I}
护照号 {I}
银行开户要填{I}
{I}被人拿去贷款了
挂号填的是{I}
学籍里登记的{I}
{I} 提示不匹配
要{I}
填{I}
港澳通行证和护照 {I} 都丢了
住{A}
我住{A}
家在{A}
地址{A}
地址：{A}
送到{A}
寄到{A}
搬到{A}
去{A}取
到{A}
在{A}
老宅在{A}
学区房位于{A}
房产证上写的{A}
{A}出租
{A}楼下集合
救护车开到了{A}
户籍{A}
快递柜在{A}
送去{A}
填的{A}
{A}，来拿
地址{A}，{N}收
{N}，{P}，{A}
speak with {N}
speak to {N}
ask {N}
ask for {N}
call {N}
hello {N}
hi {N}
Hi {N}, the lease is attached
Dear {N}
Dear {N}, the clinic moved your visit
dear {N}
sincerely, {N}
regards, {N}
cheers, {N}
thanks, {N}
thanks to {N}
thank {N} for me
I am {N}
my name is {N}
named {N}
his name was {N}
this is {N} speaking
my landlord {N} said no
our tutor {N} was patient
nurse {N} took my blood
the plumber {N} came late
{N} came by on Tuesday
{N} fixed the boiler
{N} signed the lease
{N} called
{N} called me twice
{N} helped me
{N} helped
{N} never came
{N} wrote to me
{N} from the bank rang
{N} from the office
{N} from accounts wrote
{N} at the bank
{N} at the clinic was kind
meet {N} at noon
paid to {N}
signed by {N}
sent by {N}
written by {N}
handled by {N}
taken by {N}
to {N}
for {N}
with {N}
by {N}
from {N}
attn: {N}
tenant: {N}
name: {N}
name on the lease: {N}
contact {N}
contact {N} about the keys
talk to {N} in payroll
{N} still owes me rent
write to {E}
email {E}
email: {E}
mail me at {E}
my email is {E}
reach us: {E}
send your resume to {E}
the invoice went to {E}
forward it to {E}
account {E}
contact {E}
{E} is down
{E} works
from {E}
at {E}
call {P}
call me at {P}
text {P}
phone {P}
phone: {P}
tel {P}
mobile {P}
cell {P}
ring {P} after nine
my number: {P}
my number is {P}
fax {P}
whatsapp {P}
dial {P} for the landlord
number {P} is dead
{P} is my mother's line
{P} rings
at {P}
on {P}
SSN {I}
my SSN is {I}
social security {I}
passport {I}
passport number {I}
passport: {I}
ID {I}
ID number {I}
ID: {I}
the visa form wants {I}
the bank wrote {I} on the cheque
I live at {A}
we live at {A}
lives at {A}
address {A}
address: {A}
my address is {A}
moved to {A}
send it to {A}
sent to {A}
ship to {A}
deliver to {A}
come to {A}
the viewing is at {A}
the party is at {A}
we rent {A}
parked outside {A}
at {A}
to {A}
by {A}
is {A}
in {A}
from {A}
went to {A}
{A} is for rent
{N}, {A}
订单{x}
订单号{x}
订单编号：{x}没动静
运单号{x}
快递单号 {x}
流水号{x}对不上账
发票号码{x}
学号{x}
条形码{x}
型号{c}
序列号{x}
房间密码{d}
批号{x}过期了
产品编号{x}X
邀请码：{x}
激活码{c}-{d}
热线400-{d}{d}-{d}{d}
热线400{d}{d}{d}
热线800-{d}{d}-{d}{d}
银行热线400-8{d}-9{d}1一直排队
沿着{d}国道骑车
{d}号线转{d}号线
第{d}号选手
{d}楼的食堂
版本{d}.{d}.{d}
系统{d}.{d}已推送
QQ群{x}
{d}分{d}秒
{d}点{d}分开会
{c}的充电口
有人用{c}吗
{c}
{c}不错
{c}在手
说{c}
这台{c}
编号{c}
@小雨
@小林 快来看
@老张的杂货铺 在吗
order {x}
order {x} shipped
tracking number {x}
tracking {x}
invoice {x} is overdue
batch {x}
batch {x}X
lot {x}X
serial {x}
coupon {x} expired
code {x}
part {x}
helpline 1-800-{d}{d}-{d}{d}
hotline 1-800-{d}{d}-{d}{d}
call 1-800-{d}{d}-{d}{d} toll free
version {d}.{d}.{d}
build {d}.{d}.{d} crashes
model {c}
model {c} came
my {c}
the {c}
{c} owner
a {c} here
{c} here
route {d} east
room {d}
chapter {d} of {d}
I spent {d} dollars on {d} tickets
page {d} is missing
角色{w}
角色{w}换装
主角{w}
男主{w}
女主{w}
将军{w}
反派{w}下线了
新角色皮肤上架
首领二阶段太难
主角团全员回归
欧阳剑仙的皮肤好看
诸葛军师技能加强
李白的诗要背
杜甫草堂人太多
Captain Sorell leads the guild
Lady Venn is a hard boss
the boss Grimjaw
hero Tarvin got a new skin
King Arthur is a legend
the new hero Brakka
Chapter Three was dull
Happy New Year
Good Morning America
Red Dragon Tavern closed
Summer Sale starts Monday
Street food was great
Road works all week
The Avenue mall
Error {d}
File Not Found
Bad Request
反馈{w}
整体{w}
比较{w}
还是{w}
觉得{w}
变得{w}了
有点{w}
{w}
{w}这块
{w}，{w}
说{w}
很{w}
印象是{w}
大于{w}
胜在{w}
谢谢{w}
感谢{w}
是{w}
请{w}
给{w}
在{w}
找{w}
联系{w}
祝{w}安康
祝大家考试顺利
预祝演出成功
白日做梦
像话吗
费心了
全班都到了
全靠大家帮忙
高中同学聚会
明天要下雨
万万没想到
应该可以吧
何必呢
任务完不成了
马上开学了
安静点行不行
方便面吃腻了
时间不够用
水电费涨了
花了不少钱
云南那边下雪了
江南的雨季长
石膏要戴三周
毛笔字写得丑
贝多芬的曲子难弹
康师傅和统一都行
王者段位掉了
老王家的包子
小李子又获奖
{k}
{k}的{w}
{k}很{w}
这款{k}
用{k}
我的{k}
把{k}
说{k}
拿{k}
{k}还行
买了{k}
{k}降价了
{k}更新了{d}次
昨晚刷到{k}的广告
食堂的红烧肉咸了
地铁里空调开得太足
作业拖到半夜才写
阳台的花全枯了
猫把沙发抓烂了
导师又改了论文题目
医院排队排到下午
房租一年涨两回
健身房倒闭了
考研成绩出来了
电影后半段拖沓
这家火锅底料偏辣
高速堵了{d}公里
排位连输{d}把
手续费收了{d}元
跑了{d}公里膝盖疼
the {k}
the {k} is light
my {k}
a {k}
{k} review
{k} is good
{k} works
{k} sold out
{k} got an update
{k} in blue
I love {k}
{k} or {k}
I use {k}
about {k}
with the {k}
on the {k}
for the {k}
The {k}
{k} patch notes
My cat ruined the sofa
Rent went up again
The lecture ran late
Our flight was cancelled
It rained for {d} days
Traffic on the bridge was awful
Dinner was cold
The film drags near the end
Exam results are out
The gym closed down
Nobody likes Mondays
We hiked {d} miles
Then the lights went out
Also the bus was late
Still waiting for spring
Honestly I prefer tea
After lunch we left
Before noon it snowed
Best holiday ever
Never again
""".strip().split("\n")

#: Frames that training never sees; the tests measure with them.
HELD_OUT = """
车主{N}把车开走了
义工{N}送来的毛毯
跟单员{N}
遗嘱里写给{N}
{N}考上了大学
喊{N}起床
表格回传 {E} 备案
{E} 被盗了
保姆{P}
叫车请拨 {P}
{P} 打过来推销
医保绑定{I}
{I} 查无此人
外卖送错到{A}
{A}漏水了
办事处迁往{A}
my dentist {N} retired
we hired {N} in May
{N} lost the keys
a letter for {N}
subscribe with {E}
{E} got hacked
page me on {P}
{P} belongs to my aunt
the card shows {I}
renew passport {I} online
the taxi dropped us at {A}
{A} has a blue door
座位{x}
编码{c}有误
候机楼里人挤人
窗帘的颜色太深
{k}断货了
ticket {x} was lost
the {k} broke
Autumn leaves are falling
""".strip().split("\n")


#: What stands before and after private data or anything else, for the loose rows.
BEFORE_ZH = "给 找 叫 请 问 让 跟 和 对 被 由 是 有 见 等 约 陪 替 向 快递员 店员 老师 医生 房东 师傅 同事 店里的 那个 写的是 填的 说是 到 在 去 往 从 搬到 送去 送到 送去了 寄到了 搬去 住在 仓库在 地点在 位置在 老家在 打 拨 用 核对 绑定 登记的 上传的 记得 昨天 今天 刚才 结果 后来 反正 感觉".split()
LINKS_ZH = "属于 关于 由于 等于 对于 终于 在于 高于 低于 至于 善于 过于 便于 如何 为何 以及 平安 保安 公安 治安 成都 现金 黄金 年华 中华 豪华 豪车 汽车 高高 提高 最高".split() * 3
AFTER_ZH = "说 放 送 来 去 收 签 修 给 要 帮 写 打 接 拿 走 在 很 也 都 不 没 就 能 会 处理 负责 同意 放错 送错 取 代收 拿错 女士 先生 小姐 打不通 没人接 提示 总 老 不过审 失败 报错 已经 总是 以后 附近 门口 那边 旁边 的时候 了".split()
VERBS_EN = "bought got kept found tried liked broke lost returned opened washed packed sold picked ordered borrowed charged cleaned shook dropped fixed love hate want need use miss keep put bring take leave carry hold wear drive".split()
PEOPLE_EN = "ask call meet thank tell with for from by to and hello see saw visit texted emailed helped".split()
AFTER_EN = "today again yesterday later at noon after work on Friday please for me and left because it rained over lunch in May since the move before dinner".split()


class Filler:
    """Fills slots from the lists, the same way for the same seed."""

    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def pick(self, text: str) -> str:
        return self.r.choice(text.split())

    def made(self) -> str:
        """A word that no list holds."""
        return self.pick(HEADS) + self.r.choice(["", "", self.pick(HEADS)]) + self.pick(TAILS)

    def named(self) -> str:
        """The same as a brand would write it, now and then with an accent."""
        word = self.made().title()
        return word if self.r.random() < 0.8 else word.replace("o", "ö", 1).replace("e", "é", 1).replace("n", "ñ", 1)

    def place(self) -> str:
        return "".join(self.r.choice(PLACE) for _ in range(2))

    def host(self) -> str:
        r = self.r
        name = r.choice([self.made(), self.made() + self.pick("mail post net box"), self.pick("mail post corp shop info office") + "." + self.made(), self.pick("mail inbox letters post corp"), self.digits(3), self.pick("gmail qq outlook sina yahoo")])
        return name + "." + self.pick("com com com net org cn com.cn co.uk io edu example example.com example.org test invalid")

    def E(self, en: bool) -> str:
        r = self.r
        first, last = r.choice([self.made(), r.choice(FIRST).lower()]), r.choice([self.made(), r.choice(LAST).lower()])
        letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice([1, 3, 4])))
        user = r.choice([first + self.digits(r.choice([2, 3])), f"{first}.{last}", f"{letters}_{self.digits(4)}", letters[0] + self.digits(8), f"{first}-{self.digits(2)}", first[0] + last, self.digits(9)])
        host, form = self.host(), r.choice("aaaaabcdeu")
        if form == "b":
            return f"{user} @ {host.replace('.', ' . ')}"
        if form == "c":
            return f"{user} (at) {host}"
        if form == "d":
            return f"{user}[at]{host.replace('.', '[dot]')}"
        if form == "e":
            return f"{user} at {host.replace('.', ' dot ')}"
        return f"{user}@{host}".upper() if form == "u" else f"{user}@{host}"

    def P(self, en: bool) -> str:
        r, d = self.r, self.digits
        if en and r.random() < 0.85:
            return r.choice([f"{r.randint(2, 9)}{d(2)}-555-{d(4)}", f"({r.randint(2, 9)}{d(2)}) 555-{d(4)}", f"+1 {r.randint(2, 9)}{d(2)} 555 {d(4)}", f"{r.randint(2, 9)}{d(2)}.555.{d(4)}", f"07700 900{d(3)}", f"+44 7700 900{d(3)}",
                             f"+49 30 {d(6)}", f"+61 4{d(2)} {d(3)} {d(3)}", f"+91 9{d(4)} {d(5)}", f"0491 570 {d(3)}", f"555-{d(4)}", f"{r.randint(2, 9)}{d(9)}", f"07{d(9)}"])
        if r.random() < 0.1:
            return "".join("零一二三四五六七八九"[int(x)] if x != "1" else "幺" for x in "1" + r.choice("3456789") + d(9))
        a, b, c = "1" + r.choice("3456789") + d(1), d(4), d(4)
        return r.choice([a + b + c, a + b + c, f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+86 {a}{b}{c}", f"(+86){a} {b}{c}", f"0{r.randint(10, 99)}{d(1)}-{d(8)}", f"(0{r.randint(10, 99)}{d(1)}) {d(4)} {d(4)}", f"{a[:3]} {b}{c}"])

    def I(self, en: bool) -> str:
        r, d = self.r, self.digits
        if en:
            return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", r.choice("ABCDEGHKLMPX") + d(8)])
        day = f"{r.randint(1950, 2009)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"
        tail = d(3) + r.choice("0123456789XXXXx")
        return r.choice([d(6) + day + tail, d(6) + day + tail, f"{d(6)} {day} {tail}", r.choice("ABCDEGHKLMPX") + d(8)])

    def A(self, en: bool) -> str:
        r = self.r
        n = lambda k=999: str(r.randint(1, k))
        if en:
            name = r.choice([self.pick(ROADS_EN), self.pick(ROADS_EN), self.made().title()])
            road = f"{name} {self.pick(EN_KIND)}"
            return r.choice([
                f"{n()} {road}", f"{n()} {road}", f"{n()} {road}", f"Flat {n(40)}, {n()} {road}", f"Apt {n(40)}, {n()} {road}", f"{n()} {road}, Unit {n(60)}", f"{n()} {road}, Apt {n(9)}{r.choice('ABCD')}", f"{n()} {road}, Flat {n(60)}",
                f"{n(99)}-{n(99)} {road} {self.pick('1st 2nd 3rd 4th')} floor", f"PO Box {n()}", f"PO Box {n()}, {road}", f"Unit {n(60)}, {n()} {road}", f"{n()}{r.choice('ABC')} {road}", f"{n()} {road}, {self.made().title()}",
            ])
        count = lambda k: r.choice("一二三四五六七八九" if k else ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十二", "二十", "三十六", "五十一", "一百零八", "一百二十"])
        road = self.place() + r.choice(["路", "街", "巷", "大道", "东路", "南街", "里", "弄"])
        tail = r.choice([f"{n()}号", f"{n()} 号", f"{n()}号{n(20)}栋{n(999)}室", f"{n()}号{n(9)}单元{n(1999)}", f"{n()}号院{n(30)}号楼", f"{n()}号{n(30)}幢{n(999)}", f"{n()} 号{n(9)}单元{n(999)}", f"{n()}号院内{n(30)}号楼", f"{count(0)}号{count(0)}楼", f"{count(0)}号"])
        spot = r.choice([road + tail, road + tail, road + tail, f"{self.place()}{r.choice('苑园')}{n(30)}-{n(9)}-{n(999)}", f"{self.place()}小区{n(30)}栋{n(999)}", f"{self.place()}小区{n(30)}号楼{n(9)}单元", f"{self.place()}村{count(1)}组{n()}号", f"{self.place()}花园{n(30)}幢{n(999)}室"])
        town = self.place() + r.choice(["市", "县", "区", "镇"])
        return r.choice(["", "", town, self.place() + "市" + self.place() + "区", self.place()]) + spot

    def N(self, en: bool) -> str:
        r = self.r
        if en:
            first, last = r.choice([r.choice(FIRST), r.choice(FIRST), self.made().title()]), r.choice([r.choice(LAST), self.made().title(), self.made().title()])
            return first + r.choice([" ", " ", " ", f" {r.choice('ABCDEHJKLMRST')}. "]) + last
        return r.choice(SURNAMES) + "".join(r.choice(GIVEN) for _ in range(r.choice([1, 1, 2, 2])))

    def K(self, en: bool) -> str:
        """A product or a work: a made-up brand and what it is."""
        r = self.r
        if en:
            name = r.choice([self.named(), self.named(), self.pick("Aurora Nimbus Pixel Titan Comet Orbit Zephyr")])
            return r.choice([f"{name} {self.pick(NOUNS)}", f"{name} {self.pick(NOUNS)}", f"{name} {r.choice('ABGSX')}{self.digits(1)}", f"#{name}{self.pick(NOUNS)}#", self.pick(NOUNS).lower()])
        name = "".join(r.choice(PLACE + GIVEN) for _ in range(2))
        return r.choice([name + self.pick(NOUNS_ZH), name + self.pick(NOUNS_ZH), self.pick(NOUNS_ZH), name + r.choice("ABGSX") + self.digits(1), self.pick(NOUNS_ZH) + r.choice(["Pro", "Max", "G7"])])


def loose(f: Filler, en: bool) -> list[tuple[str, str]]:
    """One row without a frame: a slot of any kind among words that often stand beside such."""
    r = f.r
    slot = r.choice("EPPIIAANNNNNkkkkwwcx" if not en else "EEPPIIAANNNNNNkkkkkkkkcx")
    words = lambda xs, k: (" " if en else "").join(r.choice(xs) for _ in range(k))
    value = f.digits(r.choice([6, 8, 12, 13, 15])) if slot == "x" else "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(2)) + f.digits(6) if slot == "c" else r.choice(WORDS) if slot == "w" else f.K(en) if slot == "k" else getattr(f, slot)(en)
    label = slot if slot in "EPIAN" else "O"
    if en:
        if slot == "k":
            before = r.choice([f"{r.choice(['I ', 'we ', 'they ', 'she ', 'honestly I ', ''])}{r.choice(VERBS_EN)} {r.choice(['up ', 'out ', '', ''])}the ", f"{r.choice(['', 'honestly ', 'so ', 'and ', 'but '])}the ", f"{words(VERBS_EN, 1)} my ", "The ", "about the ", "", "a ", "with the ", "of the "])
        else:
            before = words(PEOPLE_EN if slot == "N" else [*PEOPLE_EN, "at", "on", "is", "was", "number", "reach"], r.choice([0, 1, 1, 2]))
            before += " " if before else ""
        after = r.choice(["", "", " " + r.choice(["looks", "feels", "is", "was", "sounds", "never", "still", "only", *AFTER_EN]) + r.choice(["", " " + r.choice(AFTER_EN)])])
    else:
        before, after = words([*BEFORE_ZH, *WORDS, *(LINKS_ZH if slot == "w" else [])], r.choice([0, 1, 1, 2])), words([*AFTER_ZH, *AFTER_ZH, *WORDS], r.choice([0, 1, 1, 2]))
        if slot in "PIEx" and r.random() < 0.4:
            before, after = before + " ", " " + after
    return [(p, t) for p, t in ((before, "O"), (value, label), (after, "O")) if p]


def rows(copies: int = 24, seed: int = 11, frames: list[str] = FRAMES) -> list[list[tuple[str, str]]]:
    """The table: each row a text as a list of (piece, label), O for unlabelled pieces."""
    f, out = Filler(seed), []
    r = random.Random(seed + 1)
    for _ in range(copies):
        for frame in frames:
            en = not any("一" <= ch <= "鿿" for ch in frame) and (frame[0] != "{" or len(frame) > 3 or r.random() < 0.5)
            if r.random() < 0.2:  # people put two such clauses into one sentence
                other = r.choice(frames)
                if en == (not any("一" <= ch <= "鿿" for ch in other)):
                    frame += (", " if en else "，") + other
            pieces: list[tuple[str, str]] = []
            if r.random() < 0.25:
                pieces.append((r.choice(["anyway, ", "lol ", "", "well "] if en else ["对了，", "唉，", "不过", "另外", "🙃"]), "O"))
            rest = frame
            while rest:
                i = rest.find("{")
                if i < 0:
                    pieces.append((rest, "O"))
                    break
                if i:
                    pieces.append((rest[:i], "O"))
                slot, rest = rest[i + 1], rest[i + 3 :]
                if slot in "EPIAN":
                    pieces.append((getattr(f, slot)(en), slot))
                elif slot == "x":
                    pieces.append((f.digits(r.choice([6, 9, 10, 12, 12, 13, 13, 15, 16, 18])), "O"))
                elif slot == "c":
                    pieces.append(("".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(2)) + f.digits(r.choice([5, 6, 7])), "O"))
                elif slot == "w":
                    pieces.append((r.choice(WORDS), "O"))
                elif slot == "k":
                    pieces.append((f.K(en), "O"))
                else:
                    pieces.append((f.digits(r.choice([1, 2, 2, 3])), "O"))
            if r.random() < 0.3:
                pieces.append((r.choice([".", "!", " today", "..."] if en else ["。", "！", "～", "👍"]), "O"))
            if en and r.random() < 0.06:
                pieces = [(p.upper(), t) for p, t in pieces]
            out.append(pieces)
            if frames is FRAMES:
                out += [loose(f, False), loose(f, True)] if r.random() < 0.5 else [loose(f, r.random() < 0.4)]
    return out
