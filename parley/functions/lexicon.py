"""Word lists and patterns of chats, as parameters of the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Words:
    """What greetings, shared and single first persons, and half-hearted replies are told by."""

    morning: tuple[str, ...]
    morning_exact: tuple[str, ...]
    night: tuple[str, ...]
    together: str
    alone: str
    perfunctory: tuple[str, ...]
    engaged: tuple[str, ...]
    #: Characters of a greeting at most, and of a reply that is half-hearted by its shortness.
    greeting_chars: int = 8
    short_chars: int = 2


# The words that chats in Chinese are judged by.
CHAT = Words(
    morning=("早安", "早上好", "早呀", "早啊"),
    morning_exact=("早", "早~", "早！", "早!"),
    night=("晚安", "睡吧", "早点睡", "好梦"),
    together="我们|咱们|咱俩|我俩|两个人",
    alone="我(?!们)",
    perfunctory=(
        "嗯", "哦", "好吧", "随便", "都行", "好好", "行行", "好好好", "行行行", "是是是", "对对对", "呵呵呵", "随便你", "随便吧", "无所谓", "好吧好吧",
        "不知道", "不清楚", "你决定", "都可以", "没意见", "看着办", "okay",
    ),
    engaged=(
        "哈哈", "嘿嘿", "嘻嘻", "谢谢", "多谢", "辛苦", "爱你", "想你", "抱抱", "亲亲", "来了", "走了", "睡了", "起了", "在的", "在呢", "好呀", "好哒",
        "好嘞", "好滴", "好耶", "嗯呐", "嗯呢", "可以", "好的", "嗯嗯", "哦哦", "666", "999", "233", "牛", "强", "稳", "顶", "冲", "绝", "帅", "美", "棒", "赞",
    ),
)

# How a chat's system rows tell of a recall, and the name that stands for oneself.
RECALL, OWN_NAME = "^(你|.{1,30}?)撤回了一条(新)?消息", ("你",)


@dataclass(frozen=True)
class Cues:
    """What live messages are judged by: whether they move the talk on, decline, or only acknowledge."""

    questions: tuple[str, ...]
    plans: tuple[str, ...]
    details: tuple[str, ...]
    nonverbal: tuple[str, ...]
    acknowledgements: tuple[str, ...]
    strong_acknowledgements: tuple[str, ...]
    decline_at_an_end: tuple[str, ...]
    decline_within: tuple[str, ...]
    #: A beginning and an end that decline together, and a word that does except within others.
    decline_around: tuple[str, str] | None
    decline_unless: tuple[str, tuple[str, ...]] | None
    impatience: tuple[str, ...]


# Cues of live chats in Chinese.
LIVE = Cues(
    questions=("?", "？", "吗", "么", "呢", "咋", "怎么", "为什么", "要不要"),
    plans=("打算", "准备", "想", "考虑", "计划", "看能不能", "不然就", "毕业", "工作", "留学", "兼职", "大学", "高中", "专业", "考研", "高考", "实习", "租房", "搬家", "跳槽"),
    details=(
        "考试", "面试", "加班", "上班", "上课", "作业", "论文", "工资", "生活费", "省钱", "钱", "买", "游戏", "电影", "追剧", "外卖", "奶茶", "吃饭", "火锅", "旅行", "旅游",
        "机票", "酒店", "房租", "健身", "跑步", "猫", "狗", "生日", "礼物", "回家",
    ),
    nonverbal=("动画表情", "图片", "表情", "[图片]"),
    acknowledgements=("嗯", "嗯嗯", "哦", "哦哦", "好", "好的", "好吧", "好哦", "行", "行吧", "可", "可以", "收到", "知道了", "知道啦", "对", "对的", "ok", "okay"),
    strong_acknowledgements=("嗯", "嗯嗯", "哦", "哦哦", "好的", "好吧", "好哦", "收到", "知道了", "知道啦", "ok", "okay"),
    decline_at_an_end=("不了", "别了", "不聊了", "先算了", "还是算了", "就算了", "算了吧", "去不了", "约不了", "发不了", "安排不了"),
    decline_within=("你去吧", "你们去吧", "我就不去了", "先不聊了", "不想去了"),
    decline_around=("你和", "去吧"),
    decline_unless=("算了", ("算了一下", "算一算")),
    impatience=("别问了", "别说了", "别搞了", "别催了", "不想聊", "懒得说", "懒得聊", "随便吧", "随便你", "你随便", "懒得理", "受不了你"),
)
