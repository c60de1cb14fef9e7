"""Lexical tables. All values here are fixed: results depend on them as they are."""

from __future__ import annotations

# English.
STOPWORDS_EN_TOKENS = frozenset("""
a an and are as at be by for from has he in is it its of on that the to was will with you your we our
this these those they them their have had can could would should may might must shall do does did am been being
""".split())
STOPWORDS_EN = frozenset("a an and are as at be by for from has he in is it of on that the to was will with you your we our".split())
CONTRACTIONS = {
    "don't": "do not", "won't": "will not", "can't": "can not", "couldn't": "could not", "wouldn't": "would not",
    "shouldn't": "should not", "mustn't": "must not", "isn't": "is not", "aren't": "are not", "wasn't": "was not",
    "weren't": "were not", "haven't": "have not", "hasn't": "has not", "hadn't": "had not", "I'm": "I am",
    "you're": "you are", "he's": "he is", "she's": "she is", "it's": "it is", "we're": "we are", "they're": "they are",
    "I've": "I have", "you've": "you have", "we've": "we have", "they've": "they have", "I'll": "I will",
    "you'll": "you will", "he'll": "he will", "she'll": "she will", "we'll": "we will", "they'll": "they will",
}
SYNONYMS_EN = {
    "kpi": ["key performance indicator", "performance indicator", "key indicator"],
    "refund": ["refunds", "refunding", "refunded", "reimbursement", "reimburse"],
    "upgrade": ["upgrades", "upgrading", "upgraded", "enhancement", "improve"],
    "payment": ["payments", "pay", "paying", "paid", "transaction"],
    "warranty": ["warranties", "guarantee", "guarantees", "coverage"],
    "customer": ["customers", "client", "clients", "user", "users"],
    "service": ["services", "support", "assistance", "help"],
}
KEYWORDS_EN = frozenset("""
refund warranty guarantee payment upgrade service customer support price cost fee charge billing account contract
agreement terms conditions policy coverage benefit feature product kpi performance quality satisfaction experience issue problem
""".split())
NEGATIONS = frozenset("not no without never none nothing neither nor".split())
NUMBER_TOKEN = r"\$[\p{Nd},]+\.?\p{Nd}*|[\p{Nd},]+\.?\p{Nd}*%|\p{Nd}+[kKxX]|[\p{L}\p{N}_]+"

# Chinese. Later keys and synonyms replace earlier ones when the map is turned around.
SYNONYMS_ZH = {
    "客戶": ["客人", "顧客", "客戶", "陳先生", "陳生"],
    "身份": ["身份證", "ID", "證件", "身份證號碼"],
    "核實": ["確認", "核對", "驗證", "check", "保障"],
    "香港身份證": ["身份證", "ID", "證件"],
    "產品": ["product", "投資產品", "基金", "股票基金", "環球科技股票基金"],
    "信息": ["資料", "詳情", "內容", "紀錄"],
    "確認": ["確認", "核對", "驗證", "係咪"],
    "財務": ["收入", "資產", "經濟狀況", "投資金額"],
    "狀況": ["情況", "狀況", "狀態"],
    "評估": ["評估", "了解", "確認"],
    "風險": ["風險評估", "風險取向", "風險承受能力"],
    "取向": ["取向", "承受能力", "偏好"],
    "問卷": ["問卷", "評估", "測試"],
    "交易": ["買賣", "投資", "購買", "認購"],
    "價格": ["價錢", "費用", "成本", "投資金額"],
    "數量": ["份額", "單位", "數量", "金額"],
    "港幣": ["港幣", "港紙", "HKD"],
    "重要": ["重要事項", "重要聲明", "注意事項"],
    "事項": ["事項", "聲明", "條款"],
    "聲明": ["聲明", "條款", "事項"],
    "授權": ["同意", "確認", "授權", "OK"],
    "最終": ["最後", "最終", "最後確認"],
    "同意": ["同意", "確認", "OK", "好"],
}
KEYWORDS_ZH = frozenset("""
客戶 身份 核實 產品 信息 財務 風險 交易 價格 數量 重要 授權 投資 基金 確認 香港身份證 投資金額 認購 港幣 收入 流動資產 風險評估
風險取向 問卷 股票基金 環球科技 投資產品 客戶經理 身份證號碼 年度收入 財務狀況 投資目標 現金 股票 總值 年收入 收入範圍 資產狀況
經濟狀況 投資能力
""".split())
STOPWORDS_CAN = frozenset("""
嘅 咗 咁 嚟 返 曬 蚊 我 係 唔 好 都 有 冇 就 會 要 想 可以 應該 可能 一定 當然 其實 所以 因為 如果 然後 之後 之前 現在 今天 明天 昨天
呢個 呢啲 嗰個 嗰啲 一下 少少 咪 啦 㗎 目前 而家 宜家 依家 先生 小姐 女士 第一 第二 第三 第四 第五 其他 另外 同埋 同時 包括 例如 比如
通常 一般 基本 主要 重要 特別 完全 非常 相當 開始 結束 完成 記住 知道 明白 了解 繼續 停止 保持 需要 必須 或者 但係 不過 雖然 咁樣 咁嘅
點樣 邊個 邊度 幾時 點解 多少 幾多 幾個 第啲 其餘 剩係 我們 香港 今日 大約 一段
""".split())
STOPWORDS_MAN = frozenset("""
的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 可以 应该 可能 一定 当然 其实 所以 因为 如果
然后 之后 之前 现在 今天 明天 昨天 这个 这些 那个 那些 一下 一点 一些 啊 呢 目前 先生 小姐 女士 第一 第二 第三 第四 第五 其他 另外 以及
同时 包括 例如 比如 通常 一般 基本 主要 重要 特别 完全 非常 相当 开始 结束 完成 记住 知道 明白 了解 继续 停止 保持 需要 必须 或者 但是
不过 虽然 这样 那样 怎样 谁 哪里 什么时候 为什么 多少 几个 其余 剩下 只是 我们 香港 今日 大约 一段 客户 服务 而且 并且 然而 尽管 除了
除非 根据 按照 通过 经过 关于 对于 由于 因此 时候 情况 地方 时间 方面 过程 结果 能够 愿意 希望 打算 准备 如同 以前 首先 做出 任何 以免 最近
""".split())
# Speech-to-text errors: each list is written as its first word. No result is another list's input.
ASR_ERRORS = {
    "嘅": ["嘅", "既", "的"], "係": ["係", "是", "在"], "唔": ["唔", "不", "沒"], "咗": ["咗", "了", "過"], "咁": ["咁", "這樣", "這麼"],
    "嚟": ["嚟", "來"], "返": ["返", "回"], "曬": ["曬", "了"], "蚊": ["蚊", "元", "塊"],
}
TERM_WEIGHTS = {
    "基金": 2.197, "避免": 1.099, "能力": 1.099, "承受": 1.099, "透明": 1.099, "管理": 1.099, "收益": 0.405, "流動資產": 3.0, "年度收入": 3.0,
    "財務狀況": 3.0, "風險評估": 3.0, "投資金額": 2.5, "股票基金": 2.5, "香港身份證": 2.5, "身份證號碼": 2.5, "產品": 2.0, "投資": 2.0, "交易": 2.0,
    "確認": 1.0, "同意": 1.0, "係": 0.5,
}

# Weights of the metrics, and (date, number) boosts by point name.
SIMILARITY_WEIGHTS = {
    "CAN": {"semantic": 0.55, "expanded_overlap": 0.15, "rouge_l": 0.20, "keyword_coverage": 0.10},
    "MAN": {"semantic": 0.60, "expanded_overlap": 0.15, "rouge_l": 0.15, "keyword_coverage": 0.10},
    "ENG": {"semantic": 0.60, "expanded_overlap": 0.13, "rouge_l": 0.12, "keyword_coverage": 0.10, "fuzzy_similarity": 0.05},
}
BOOSTS_MAN = {
    "价格确认": (0.0, 0.20), "风险评估": (0.15, 0.0), "交易价格确认": (0.0, 0.18), "交易数量确认": (0.0, 0.20), "产品信息确认": (0.0, 0.12),
    "重要事项声明": (0.12, 0.0), "财务状况评估": (0.0, 0.15),
}
BOOSTS_CAN = {
    "Price": (0.0, 0.20), "RPQ": (0.15, 0.0), "acknowledge SFP report": (0.15, 0.0), "交易价格确认": (0.0, 0.18), "交易数量确认": (0.0, 0.20),
    "產品信息確認": (0.0, 0.12), "重要事項聲明": (0.12, 0.0), "財務狀況評估": (0.0, 0.15),
}
DYNAMIC_BOOST = 0.15
POINT_PRICE_WORDS = ("price", "floating rate")
SCRIPT_PRICE_WORDS = ("price", "interest", "%")

# Patterns of dates and amounts. Only whether one matches counts.
_N, _M = "一二三四五六七八九十", r"\p{Nd}"
DATES = {
    "MAN": [
        rf"[二零一三四五六七八九]{{2,4}}年[{_N}{_M}]{{1,3}}月[{_N}{_M}]{{1,3}}日", rf"{_M}{{4}}年[{_N}{_M}]{{1,3}}月[{_N}{_M}]{{1,3}}日",
        rf"[{_N}{_M}]{{1,3}}月[{_N}{_M}]{{1,3}}日", rf"{_M}{{4}}[-/]{_M}{{1,2}}[-/]{_M}{{1,2}}",
    ],
    "CAN": [
        rf"[二零一九八七六五四三]{{2,4}}年[{_N}{_M}]{{1,3}}月[{_N}{_M}]{{1,3}}日", rf"{_M}{{4}}年[{_N}]{{1,3}}月[{_N}]{{1,3}}日",
        rf"[{_N}]{{1,3}}月[{_N}{_M}]{{1,3}}日", rf"{_M}{{1,2}}月{_M}{{1,2}}日", rf"{_M}{{4}}[-/]{_M}{{1,2}}[-/]{_M}{{1,2}}",
    ],
}
NUMBERS = {
    "MAN": [rf"[港人民币]{{1,3}}\s*{_M}+", rf"[¥$€]\s*[{_M},]+", rf"{_M}[万千百亿元]", rf"{_M}%"],
    "CAN": [rf"[港人民币]{{1,3}}\s*{_M}+", rf"[￥$¥€£]\s*[{_M},]+", rf"{_M}[万千百亿]", rf"{_M}%"],
}


def stopwords(language: str) -> frozenset[str]:
    """Of a language; an unknown one has those of MAN."""
    return {"CAN": STOPWORDS_CAN, "ENG": STOPWORDS_EN}.get(language, STOPWORDS_MAN)


def reverse_synonyms(synonyms: dict[str, list[str]]) -> dict[str, list[str]]:
    """Each key and synonym with all words of its entry; a later entry replaces an earlier one's."""
    out: dict[str, list[str]] = {}
    for key, words in synonyms.items():
        for word in [key, *words]:
            out[word] = sorted({key, *words})
    return out
