import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkgauge import config, lexicon
from talkgauge.functions import patterns as p
from talkgauge.functions import similarity as sim
from talkgauge.functions import text as t
from talkgauge.functions import tokens as k
from talkgauge.operators import scripts as s


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for n, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text, clean", [("我哋不了解", "我哋唔咗解"), ("不過", "唔咗"), ("這樣", "咁"), ("這麼", "咁"), ("abc 123", "")])
def test_cantonese_clean(spark, text, clean):
    assert one(spark, t.clean(F.col("x"), "CAN"), x=text) == clean


def test_mandarin_and_english_clean(spark):
    assert one(spark, t.clean(F.col("x"), "MAN"), x="你好,,,世界.. abc") == "你好，世界。"
    assert one(spark, t.clean(F.col("x"), "ENG"), x="  Ａ,，b.。c ") == "A,b.c"


def test_asr_equals_sequential_replacement(spark):
    def plain(x):
        for word, errors in lexicon.ASR_ERRORS.items():
            for error in errors:
                x = x.replace(error, word)
        return x

    alphabet = "".join(sorted({c for word, errors in lexicon.ASR_ERRORS.items() for e in [word, *errors] for c in e})) + "好"
    texts = [alphabet[i:] + alphabet[::-1][:i] + x for i in range(len(alphabet)) for x in ("這樣", "這麼了", "不過")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(t.normalize_asr(F.col("x"))).collect()]
    assert got == [plain(x) for x in texts]


def test_english_tokens(spark):
    said = "We don't offer a refund for 10k upgrades (5%)."
    assert one(spark, k.english_tokens(F.col("x")), x=said) == ["not", "offer", "refund", "10k", "upgrades", "5%"]
    assert one(spark, k.negation_bigrams(k.english_tokens(F.col("x"))), x=said) == []
    expanded = set(one(spark, k.expand_en(F.col("x")), x=said))
    assert {"refunds", "refunding", "refunded", "reimbursement", "reimburse", "upgrade", "upgrading", "upgraded", "enhancement", "improve"} <= expanded
    assert set(one(spark, k.negation_bigrams(k.english_tokens(F.col("x"))), x="not refund no warranty")) == {"not_refund", "no_warranty"}
    assert one(spark, k.negation_bigrams(F.col("x")), x=[]) == []
    assert one(spark, k.expand_canonical(F.col("x")), x=["refunds", "x"]) == ["refunds", "x", "refund"]


def test_stems_without_library(spark):
    try:
        import nltk  # noqa: F401
    except ImportError:
        assert one(spark, k.stem(F.col("x")), x=["refunding", "pay"]) == ["refunding", "pay"]


def test_longest_match():
    cut = k.LongestMatch({"香港身份證", "身份", "確認"})
    assert cut("請確認香港身份證ID9號") == ["請", "確認", "香港身份證", "ID9", "號"]
    assert cut("") == []


@pytest.mark.parametrize(
    "language, script, expected",
    [
        ("MAN", "请确认身份。核实资料；再见", ["请确认身份。核实资料再见"]), ("ENG", "Hello world. Version A: please confirm; ok", ["Hello world", "please confirm ok"]),
        ("CAN", "確認身份.資料,核對", ["確認身份 資料,核對"]), ("ENG", "", []), ("ENG", "..", [".."[:1]]),
    ],
)
def test_variations(spark, language, script, expected):
    assert one(spark, s.variations(F.col("x"), language), x=script) == expected


def test_split_before_clean(spark):
    assert one(spark, s.variations(F.col("x"), "MAN", True), x="请确认身份信息;核实客户资料") == ["请确认身份信息", "核实客户资料"]


def _merge(fragments):
    out, carry = [], ""
    for x in fragments:
        now = f"{carry} {x}" if carry else x
        carry = now if len(now) <= 5 else ""
        if not carry:
            out.append(now)
    if carry:
        out[-1:] = [f"{out[-1]} {carry}"] if out else [carry]
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=1, max_size=9), max_size=6), min_size=1, max_size=20))
def test_fragment_merge(spark, lists):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lists], "x array<string>").select(s.merge_fragments(F.col("x"))).collect()]
    assert got == [_merge(x) for x in lists]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd好𠮷", max_size=30), st.text("abcd好𠮷", max_size=30))
def test_bit_parallel_lcs(a, b):
    assert sim.lcs_length(a, b) == _lcs(a, b) == sim.lcs_length(b, a)


def test_rouge_forms_agree(spark):
    pairs = [("abcbdab", "bdcaba"), ("", "a"), ("a", ""), ("same", "same"), ("ab", "cd"), ("𠮷a", "a𠮷"), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select(sim.rouge_l(F.col("a"), F.col("b")), sim.rouge_l_short(F.col("a"), F.col("b")))
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == pytest.approx((8 / 13, 8 / 13)) and rows[1:3] == [(0, 0), (0, 0)] and rows[3] == (1, 1) and rows[4] == (0, 0)
    assert rows[5][0] == rows[5][1] == 0.5


def test_overlaps_and_scores(spark):
    a, b = ["a", "b", "c"], ["b", "c", "d", "e"]
    assert one(spark, sim.overlap_max(F.col("a"), F.col("b")), a=a, b=b) == 0.5
    assert one(spark, sim.jaccard(F.col("a"), F.col("b")), a=a, b=b) == 0.4
    assert one(spark, sim.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 0
    lits = lambda *xs: map(F.lit, xs)
    assert one(spark, sim.weighted("CAN", *lits(0.4, 0.2, 0.5, 1.0))) == pytest.approx(0.45)
    assert one(spark, sim.weighted("ENG", *lits(0.5, 0.2, 0.5, 0.0))) == pytest.approx(0.386)
    assert config.weights("XXX") == config.weights("MAN")


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([-1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(sim.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.5**0.5, 0, 0, 0, -1])


@pytest.mark.parametrize("text, man, can", [("2025年10月9日", True, True), ("二零二五年十月九日", True, True), ("十月9日", True, True), ("2024-2-9", True, True), ("10年", False, False), (None, False, False)])
def test_dates(spark, text, man, can):
    assert one(spark, p.has_date(F.col("x"), "MAN"), x=text) is man and one(spark, p.has_date(F.col("x"), "CAN"), x=text) is can


@pytest.mark.parametrize("text, man, can", [("买入50万", True, True), ("5%", True, True), ("12345", False, True), ("2024", False, False), ("1234", False, False), ("100元", True, False), ("¥ 3", True, True), ("x", False, False)])
def test_numbers(spark, text, man, can):
    assert one(spark, p.has_number(F.col("x"), "MAN"), x=text) is man and one(spark, p.has_number(F.col("x"), "CAN"), x=text) is can


@pytest.mark.parametrize("point, text, base, expected", [("价格确认", "买入50万", 0.5, 0.7), ("价格确认", "买入50万", 0.9, 1.0), ("价格确认", "买", 0.5, 0.5), ("Price check", "5%", 0.3, 0.45), ("风险评估", "5%", 0.3, 0.3)])
def test_boosts(spark, point, text, base, expected):
    row = dict(point=point, text=text, base=base)
    added = p.boost(F.col("point"), p.has_date(F.col("text"), "MAN"), p.has_number(F.col("text"), "MAN"), p.dynamic_boost(F.col("point"), F.lit("")), lexicon.BOOSTS_MAN)
    assert one(spark, p.boosted(F.col("base"), added), **row) == pytest.approx(expected)


@pytest.mark.parametrize("text, seconds", [("00:18:30", 1110), ("18:30", 1110), ("1110.5", 1110.5), ("abc", 0), (None, 0), ("1:x", 0), ("-5", 0)])
def test_seconds(spark, text, seconds):
    assert one(spark, t.seconds_of(F.col("x")), x=text) == seconds


@pytest.mark.parametrize("seconds, shown", [(1110, "18:30"), (3661, "61:01"), (0, "00:00"), (None, "00:00"), (-3, "00:00"), (6000, "100:00"), (59.9, "00:59")])
def test_mmss(spark, seconds, shown):
    assert one(spark, t.mmss(F.lit(seconds).cast("double"))) == shown


def test_names_and_clips(spark):
    got = [one(spark, t.output_name(F.col("x")), x=x) for x in ("1_a_C.wav.csv", "1_a_C.csv", "1_a_C.xlsx")]
    assert got == ["1_a_C.xlsx", "1_a_C.xlsx", "1_a_C_result.xlsx"]
    assert one(spark, t.clip(F.col("x"), 3), x="abcd") == "abc..." and one(spark, t.clip(F.col("x"), 3), x="abc") == "abc"
    assert one(spark, t.nfkc(F.col("x")), x="ﬁ①Ａ") == "fi1A"
    assert one(spark, t.sentences(F.col("x")), x="Hi. Good day! Yes, go") == ["Good day", "Yes, go"]


def test_profiles():
    assert config.profile(1).name == "INV" and config.profile(2).name == "INS"
    with pytest.raises(ValueError):
        config.profile(3)
    with pytest.raises(ValueError):
        config.Settings("FRA")
    assert config.Settings("CAN").cut == 0.3 and config.Settings("ENG").cut == 0.4
    assert config.Settings("ENG", legacy_keywords=True).keywords is lexicon.KEYWORDS_ZH
