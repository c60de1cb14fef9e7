"""Every dialogue group against every point of its sheet, and the best of them.

A point is one row with all its texts, the holistic one and the variations, as an array, so a pair of group and point is one row too and is
scored where the join makes it: nothing is shuffled before the best group of a call's point is chosen. Scripts are the small side of
that join: they are broadcast if a count shows that they are, and else spread over salted copies so that no sheet's calls meet in one task. The
holistic text is scored first; in MAN and ENG variations are scored for those pairs only that it leaves open. The sequence metric and the vectors' cosines
come before the join: each group once with all texts of its sheet, so that pairs with their texts and words don't wait for Python and carry no vectors. Wider sheets are scored pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgauge.config import Settings
from talkgauge.functions import patterns as p
from talkgauge.functions import similarity as s
from talkgauge.functions import text as t
from talkgauge.functions import tokens as k
from talkgauge.functions.arrays import let
from talkgauge.operators.embedding import Embedder, embed, with_vectors

#: Script texts (points and variations) that are broadcast at most.
BROADCAST_TEXTS = 50_000
#: Texts of a sheet with which a group is compared before it is joined; it carries a number for each.
SHEET_TEXTS = 1_000
SALTS = 32
METRICS = ("semantic", "expanded_overlap", "rouge_l", "keyword_coverage")


def features(df: DataFrame, text: str, prefix: str, settings: Settings, embedder: Embedder | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """Adds what comparisons use: clean text, expanded tokens, business tokens, important keywords and, where the score has them, a vector of length one.

    With ``embeddings`` (clean_text, embedding) vectors are looked up there first, and each distinct text that has none is encoded once.
    """
    language = settings.language
    df = df.withColumn(f"{prefix}_clean", t.clean(F.col(text), language))
    df = df.withColumn("_raw", k.segment(F.col(f"{prefix}_clean"), language))
    df = df.withColumn(f"{prefix}_tokens", k.expanded_tokens(F.col("_raw"), language)).withColumn(f"{prefix}_words", k.business_tokens(F.col("_raw"), language)).drop("_raw")
    df = df.withColumn(f"{prefix}_keys", F.array_intersect(f"{prefix}_words", k.words_array(settings.keywords)))
    if embedder is None:
        return df
    vector = f"{prefix}_vector"
    df = df.withColumn(vector, embed(F.col(f"{prefix}_clean"), embedder)) if embeddings is None else with_vectors(df, f"{prefix}_clean", embeddings, embedder, vector)
    return df.withColumn(vector, s.unit(F.col(vector)))


def join_sheet(groups: DataFrame, scripts: DataFrame, n_texts: int | None = None, most: int = BROADCAST_TEXTS) -> DataFrame:
    """Groups with all script rows of their sheet."""
    n_texts = scripts.count() if n_texts is None else n_texts
    if n_texts <= most:
        return groups.join(F.broadcast(scripts), "sheet")
    copies = scripts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = groups.withColumn("_salt", F.pmod(F.xxhash64("call_id", "group_id"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["sheet", "_salt"]).drop("_salt")


def metrics(settings: Settings, script: Column, group: Column, cosine: Column | None = None, rouge: Column | None = None) -> Column:
    """The metrics of a pair and their weighted score, as one struct; ``script`` and ``group`` have tokens, words and keys.

    ``cosine`` is the semantic or TF-IDF cosine and ``rouge`` the sequence metric; without one its part of the score is 0.
    """
    language, zero = settings.language, F.lit(0.0)
    a, b = script["tokens"], group["tokens"]  # without repeats, so sizes of sets are sizes of arrays
    cosine, rouge = zero if cosine is None else cosine, zero if rouge is None else rouge
    hits = F.size(F.array_intersect(script["keys"], group["words"]))
    # Bound step by step: Spark computes an expression again wherever it stands.
    parts = F.struct(F.size(F.array_intersect(a, b)).alias("common"), F.size(a).alias("a"), F.size(b).alias("b"), hits.alias("hits"), F.size(script["keys"]).alias("keys"), cosine.alias("cosine"), rouge.alias("rouge"))

    def shares(p: Column) -> Column:
        whole = F.greatest(p["a"], p["b"]) if language == "CAN" else p["a"] + p["b"] - p["common"]
        overlap, keywords = F.coalesce(F.try_divide(p["common"], whole), zero), F.coalesce(F.try_divide(p["hits"], p["keys"]), zero)
        return F.struct(p["cosine"].alias("semantic"), overlap.alias("expanded_overlap"), p["rouge"].alias("rouge_l"), keywords.alias("keyword_coverage"))

    def scored(m: Column) -> Column:
        score = s.weighted(language, m["semantic"], m["expanded_overlap"], m["rouge_l"], m["keyword_coverage"])
        return F.struct(score.alias("score"), *(m[name].alias(name) for name in METRICS))

    return let(let(parts, shares), scored)


def numbered(points: DataFrame) -> DataFrame:
    """Adds ``first``: the place of a point's holistic text among its sheet's texts; variations follow it."""
    before = Window.partitionBy("sheet").orderBy("point_order", "point").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("first", F.coalesce(F.sum(F.size("variations") + 1).over(before), F.lit(0)).cast("int"))


def count_texts(points: DataFrame) -> tuple[int, int]:
    """How many script texts there are, and how many the widest sheet has."""
    sheets = points.groupBy("sheet").agg(F.sum(F.size("variations") + 1).alias("n"))
    return tuple(sheets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first())


def sheet_rouge(points: DataFrame, language: str, n_texts: int, widest: int) -> Callable[[Column, Column], Column] | None:
    """A function of a sheet and a clean text: ROUGE-L with all texts of the sheet, by their places; None if there are too many to send out."""
    if n_texts > BROADCAST_TEXTS or widest > SHEET_TEXTS:
        return None
    rows = numbered(points).select("sheet", "first", F.posexplode(F.concat(F.array("holistic"), "variations")).alias("pos", "x"))
    texts: dict[str, list[str]] = {}
    for row in sorted(rows.select("sheet", (F.col("first") + F.col("pos")).alias("place"), t.clean(F.col("x"), language).alias("x")).filter("sheet is not null").collect(), key=lambda r: r.place):
        texts.setdefault(row.sheet, []).append(row.x)
    return s.rouge_l_all(texts)


def sheet_cosine(points: DataFrame, settings: Settings, embedder: Embedder, n_texts: int, widest: int) -> Callable[[Column, Column], Column] | None:
    """A function of a sheet and a clean text: cosines of vectors with all texts of the sheet, as sheet_rouge has them."""
    if n_texts > BROADCAST_TEXTS or widest > SHEET_TEXTS:
        return None
    rows = numbered(points).select("sheet", "first", F.posexplode(F.concat(F.array("holistic"), "variations")).alias("pos", "x")).filter("sheet is not null")
    rows = features(rows, "x", "s", settings, embedder).select("sheet", (F.col("first") + F.col("pos")).alias("place"), "s_vector")
    vectors: dict[str, list[list[float] | None]] = {}
    for row in sorted(rows.collect(), key=lambda r: r.place):
        vectors.setdefault(row.sheet, []).append(row.s_vector)
    return s.cosine_all(vectors, embedder)


def rouge_l_pairs(groups: DataFrame, points: DataFrame, language: str) -> DataFrame:
    """``call_id, group_id, point, pos, rouge_l``: each group with every script text of its sheet, of each point the holistic text (pos -1) and all variations."""
    n_texts, widest = count_texts(points)
    each = sheet_rouge(points, language, n_texts, widest)
    texts = numbered(points).select("sheet", "point", "first", F.posexplode(F.concat(F.array("holistic"), "variations")).alias("pos", "script"))
    clean, pos = t.clean(F.col("text"), language), (F.col("pos") - 1).alias("pos")
    if each is None:
        left = groups.select("call_id", "group_id", "sheet", clean.alias("g"))
        rows = join_sheet(left, texts.withColumn("script", t.clean(F.col("script"), language)), n_texts)
        return rows.select("call_id", "group_id", "point", pos, s.rouge_l(F.col("script"), F.col("g")).alias("rouge_l"))
    left = groups.select("call_id", "group_id", "sheet", each(F.col("sheet"), clean).alias("_all"))
    rows = join_sheet(left, texts.drop("script"), n_texts)
    return rows.select("call_id", "group_id", "point", pos, F.get("_all", F.col("first") + F.col("pos")).alias("rouge_l"))


def point_rows(points: DataFrame, settings: Settings, embedder: Embedder | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """One row for each point: ``sheet, point, point_order, first, all_variations_count, dynamic_boost, texts``, the holistic text (pos -1) and the variations with their features."""
    all_texts = F.concat(F.array("holistic"), "variations")
    rows = numbered(points).select("sheet", "point", "point_order", "first", F.size("variations").cast("long").alias("all_variations_count"), p.dynamic_boost(F.col("point"), F.array_join("scripts", " ")).alias("dynamic_boost"), F.posexplode(all_texts).alias("pos", "script"))
    rows = features(rows.withColumn("pos", F.col("pos") - 1), "script", "s", settings, embedder, embeddings)
    names = ["clean", "tokens", "words", "keys", *(["vector"] if embedder else [])]
    item = F.struct("pos", "script", *(F.col(f"s_{name}").alias(name) for name in names))
    return rows.groupBy("sheet", "point", "point_order", "first", "all_variations_count", "dynamic_boost").agg(F.array_sort(F.collect_list(item)).alias("texts"))


def pairwise(groups: DataFrame, points: DataFrame, settings: Settings, embedder: Embedder | None = None, cosines: DataFrame | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """One row for each group and point of its sheet: scores, match type and best variation.

    ``groups``: call_id, group_id, sheet, speaker, text; ``points``: sheet, point, point_order, scripts, variations, holistic.
    MAN and ENG take the holistic match if its boosted score reaches the threshold, and look at variations only if it doesn't;
    CAN looks at both and boosts the winner. ``cosines`` (call_id, group_id, point, pos, cosine), CAN's TF-IDF, take the place of vectors. The holistic match wins only if it is strictly better; of equal variations the first wins.
    """
    n_texts, widest = count_texts(points)
    each_rouge = sheet_rouge(points, settings.language, n_texts, widest) if settings.use_rouge else None
    each_cosine = sheet_cosine(points, settings, embedder, n_texts, widest) if embedder and embeddings is None and cosines is None else None
    if each_cosine:
        embedder = None
    left = features(groups.select("call_id", "group_id", "sheet", "speaker", "text"), "text", "g", settings, embedder, embeddings)
    left = left.withColumn("g_date", p.has_date(F.col("text"), settings.language)).withColumn("g_number", p.has_number(F.col("text"), settings.language))
    if each_rouge:
        left = left.withColumn("_all", each_rouge(F.col("sheet"), F.col("g_clean")))
    if each_cosine:
        left = left.withColumn("_cosine", each_cosine(F.col("sheet"), F.col("g_clean")))
    rows = join_sheet(left, point_rows(points, settings, embedder, embeddings), n_texts)
    before = lambda name, x: F.get(name, F.col("first") + x["pos"] + 1)
    cosine = (lambda x: before("_cosine", x)) if each_cosine else (lambda x: s.cosine_of_units(x["vector"], F.col("g_vector"))) if embedder else None
    if cosines is not None:
        found = cosines.groupBy("call_id", "group_id", "point").agg(F.map_from_entries(F.collect_list(F.struct("pos", "cosine"))).alias("_cosines"))
        rows = rows.join(found, ["call_id", "group_id", "point"], "left")
        cosine = lambda x: F.coalesce(F.try_element_at(F.col("_cosines"), x["pos"]), F.lit(0.0))
    group = F.struct(F.col("g_tokens").alias("tokens"), F.col("g_words").alias("words"))
    scored = lambda x, rouge: metrics(settings, x, group, cosine and cosine(x), rouge)
    rows = rows.withColumn("added", p.boost(F.col("point"), F.col("g_date"), F.col("g_number"), F.col("dynamic_boost"), settings.point_boosts)).withColumn("_h", F.get("texts", F.lit(0)))
    rouge = before("_all", F.col("_h")) if each_rouge else s.rouge_l(F.col("_h.clean"), F.col("g_clean")) if settings.use_rouge else None
    rows = rows.withColumn("h", scored(F.col("_h"), rouge))
    holistic = F.col("h.score")
    early = F.lit(False) if settings.language == "CAN" else p.boosted(holistic, F.col("added")) >= settings.cut
    rows = rows.withColumn("_open", F.when(early, F.array().cast(rows.schema["texts"].dataType)).otherwise(F.slice("texts", F.lit(2), F.greatest(F.size("texts") - 1, F.lit(0)))))
    # A variation's metrics, its place behind the score, so that the greatest struct is the best score and of equal ones the first.
    ranked = lambda m, x: F.struct(m["score"].alias("score"), (-x["pos"]).alias("place"), *(m[name].alias(name) for name in METRICS))
    if settings.use_rouge and not each_rouge:
        rows = rows.withColumn("_rouge", s.rouge_l_each(F.transform("_open", lambda x: x["clean"]), F.col("g_clean")))
        each = F.transform("_open", lambda x, i: let(scored(x, F.get(F.col("_rouge"), i)), lambda m: ranked(m, x)))
    else:
        each = F.transform("_open", lambda x: let(scored(x, before("_all", x) if each_rouge else None), lambda m: ranked(m, x)))
    rows = rows.withColumn("g", F.array_max(F.filter(each, lambda m: m["score"] > 0)))
    granular = F.coalesce(F.col("g.score"), F.lit(0.0))
    if settings.language == "CAN":
        wins = holistic > granular
        h, g, score = holistic, granular, p.boosted(F.greatest(holistic, granular), F.col("added"))
    else:
        h, g = p.boosted(holistic, F.col("added")), p.boosted(granular, F.col("added"))
        wins = early | (h > g)
        g = F.when(early, 0.0).otherwise(g)
        score = F.when(wins, h).otherwise(g)
    rows = rows.withColumn("_wins", wins).withColumn("won", F.when(F.col("_wins"), F.col("_h")).otherwise(F.get("texts", 1 - F.col("g.place"))))
    metric = lambda name: F.coalesce(F.when(F.col("_wins"), F.col(f"h.{name}")).otherwise(F.col(f"g.{name}")), F.lit(0.0)).alias(name)
    return rows.select(
        "call_id", "group_id", "sheet", "speaker", "text", "point", "point_order", "all_variations_count", "dynamic_boost", score.alias("weighted_score"),
        F.when(F.col("_wins"), holistic).otherwise(granular).alias("original_score"), F.when(F.col("_wins"), "Holistic").otherwise("Granular").alias("match_type"),
        F.coalesce("won.script", F.lit("")).alias("best_variation"), h.alias("holistic_score"), g.alias("granular_score"),
        *map(metric, METRICS), F.coalesce(F.array_intersect("won.words", "g_words"), F.array().cast("array<string>")).alias("shared"),
    )


def best_groups(pairs: DataFrame, settings: Settings) -> DataFrame:
    """One row for each call and point: its best group.

    The greatest score, of equal ones the first group. CAN stops at the first group that reaches early_exit, and has
    group -1 if no score is over 0.
    """
    row = F.struct(*[c for c in pairs.columns if c not in ("call_id", "sheet", "point", "point_order")])
    first_best = F.max_by(row, F.struct("weighted_score", -F.col("group_id")))
    if settings.language == "CAN":
        early = F.min_by(row, F.when(F.col("weighted_score") >= settings.early_exit, F.col("group_id")))
        first_best = F.coalesce(early, first_best)
    best = pairs.groupBy("call_id", "sheet", "point", "point_order").agg(first_best.alias("b")).select("call_id", "sheet", "point", "point_order", "b.*")
    if settings.language != "CAN":
        return best
    none = F.col("weighted_score") <= 0
    return best.withColumn("group_id", F.when(none, F.lit(-1).cast("long")).otherwise(F.col("group_id"))).withColumn("text", F.when(none, "").otherwise(F.col("text"))).withColumn("speaker", F.when(none, "").otherwise(F.col("speaker")))


def coverage(pairs: DataFrame, settings: Settings) -> DataFrame:
    """The coverage result: whether each point is covered, by which group, and why."""
    best = best_groups(pairs, settings)
    important = k.words_array(settings.keywords)
    shared = F.concat(F.array_sort(F.array_intersect("shared", important)), F.array_sort(F.array_except("shared", important)))
    shown = (lambda c, n: F.col(c)) if settings.language == "CAN" else (lambda c, n: t.clip(F.col(c), n))
    variation = F.col("best_variation") if settings.language == "CAN" else t.clip(t.clean(F.col("best_variation"), settings.language), 100)
    return best.select(
        "call_id", "sheet", "point", "point_order", F.when(F.col("weighted_score") >= settings.cut, "Covered").otherwise("Not Covered").alias("covered"),
        "weighted_score", "original_score", (F.col("weighted_score") - F.col("original_score")).alias("enhancement_boost"), "semantic", "rouge_l", "keyword_coverage", "expanded_overlap",
        "dynamic_boost", "match_type", variation.alias("best_variation"), shown("text", 200).alias("matched_group"), "group_id", "speaker",
        F.when(F.col("weighted_score") > 0, F.array_join(shared, ", ")).otherwise("").alias("overlapping_keywords"), "all_variations_count", "holistic_score", "granular_score",
    )
