"""Reports of calls: indicators, speakers, coverage lists and the view of groups by points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgauge.functions import text as t
from talkgauge.functions import tokens as k

LABEL = 30
TOP_WORDS = 10


def coverage_kpis(coverage: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One row for each call: points, covered, uncovered, rate in per cent, and the end time of its last row."""
    covered = F.col("covered") == "Covered"
    out = coverage.groupBy("call_id").agg(F.count("*").alias("total_points"), F.count_if(covered).alias("covered_points"), F.count_if(~covered).alias("uncovered_points"))
    out = out.withColumn("coverage_rate", F.col("covered_points") * 100.0 / F.col("total_points"))
    return out if calls is None else out.join(total_duration(calls), "call_id", "left")


def total_duration(calls: DataFrame) -> DataFrame:
    """``call_id, total_duration``: the last row's end time by position; N/A where it is missing."""
    last = F.max_by(F.struct("end_time"), "row_idx")["end_time"]
    return calls.groupBy("call_id").agg(F.coalesce(last, F.lit("N/A")).alias("total_duration"))


def top_words(rows: DataFrame, keys: list[str], n: int = TOP_WORDS) -> DataFrame:
    """``keys, word, n_words, place``: the most frequent tokens; ties go to the one that comes first. ``rows``: keys, row_idx, tokens."""
    each = rows.select(*keys, "row_idx", F.posexplode("tokens").alias("pos", "word"))
    counts = each.groupBy(*keys, "word").agg(F.count("*").alias("n_words"), F.min(F.struct("row_idx", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_words"), "first"))
    return counts.withColumn("place", place).filter(F.col("place") <= n).drop("first")


def speaker_stats(calls: DataFrame, language: str = "ENG") -> DataFrame:
    """One row for each call and speaker: role, seconds of speech, characters, characters a second and top words.

    System recordings have the role System and no figures. Of the others the one with the most characters is Sales, the next
    Customer; ties go to who speaks first. Segments that end before they start don't count.
    """
    human = calls.filter(~F.col("is_system") & F.col("speaker").isNotNull())
    seconds = t.seconds_of(F.col("end_time")) - t.seconds_of(F.col("start_time"))
    timed = F.col("start_time").isNotNull() & F.col("end_time").isNotNull() & (seconds >= 0)
    chars = F.length(F.replace(t.text_or_empty(F.col("text")), F.lit(" "), F.lit("")))
    stats = human.groupBy("call_id", "speaker").agg(
        F.sum(F.when(timed, seconds).otherwise(0.0)).alias("speaking_seconds"), F.sum(chars).alias("word_count"), F.min("row_idx").alias("first_row")
    )
    place = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("word_count"), "first_row"))
    role = F.when(place == 1, "Sales").when(place == 2, "Customer").otherwise("Other")
    stats = stats.withColumn("role", role).withColumn("words_per_second", F.when(F.col("speaking_seconds") > 0, F.col("word_count") / F.col("speaking_seconds")).otherwise(0.0))
    tokens = human.select("call_id", "speaker", "row_idx", k.business_tokens(k.segment(t.text_or_empty(F.col("text")), language), language).alias("tokens"))
    words = top_words(tokens, ["call_id", "speaker"]).groupBy("call_id", "speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("top_words"))
    stats = stats.join(words, ["call_id", "speaker"], "left").drop("first_row")
    system = calls.filter("is_system").select("call_id", "speaker").distinct().join(stats.select("call_id", "speaker"), ["call_id", "speaker"], "left_anti").withColumn("role", F.lit("System"))
    return stats.unionByName(system, allowMissingColumns=True)


def role_counts(stats: DataFrame) -> DataFrame:
    """``call_id, sales_word_count, customer_word_count``."""
    of = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("word_count"))), F.lit(0)).alias(f"{role.lower()}_word_count")
    return stats.groupBy("call_id").agg(of("Sales"), of("Customer"))


def detailed_coverage(coverage: DataFrame) -> DataFrame:
    """The coverage list as business reads it: marked, renamed, the reasons last."""
    marked = F.when(F.col("covered") == "Covered", F.concat(F.lit("✅ "), F.col("covered"))).otherwise(F.concat(F.lit("❌ "), F.col("covered")))
    first = ["call_id", F.col("point").alias("Required_Discussion_Point"), F.col("best_variation").alias("Standard_Script"), marked.alias("Covered"), F.col("matched_group").alias("Matched_Group (Call Text)"), F.col("speaker").alias("Speaker"), F.col("overlapping_keywords").alias("Overlapping_Keywords"), F.col("group_id").alias("Group_ID"), F.col("all_variations_count").alias("All_Variations_Count")]
    named = {"call_id", "point", "best_variation", "covered", "matched_group", "speaker", "overlapping_keywords", "group_id", "all_variations_count"}
    return coverage.select(*first, *[c for c in coverage.columns if c not in named])


def point_labels(points: list[str], n: int = LABEL) -> dict[str, str]:
    """Column names of points: the first characters and an ellipsis; a label that is taken gets a number."""
    out: dict[str, str] = {}
    for point in points:
        label = point if len(point) <= n else point[:n] + "..."
        base, i = label, 2
        while label in out.values():
            label, i = f"{base}#{i}", i + 1
        out[point] = label
    return out


def call_view(pairs: DataFrame, points: list[str], threshold: float) -> DataFrame:
    """One row for each group, with hit, score and the group's top words for each point."""
    labels = point_labels(points)
    hit = F.when(F.col("weighted_score") >= threshold, "YES").otherwise("NO")
    columns = []
    for point, label in labels.items():
        own = F.col("point") == point
        columns += [
            F.coalesce(F.max(F.when(own, hit)), F.lit("NO")).alias(f"{label}_Hit"), F.coalesce(F.max(F.when(own, F.col("weighted_score"))), F.lit(0.0)).alias(f"{label}_Score"),
            F.coalesce(F.max(F.when(own & (F.col("weighted_score") > 0), F.array_join("shared", ", "))), F.lit("")).alias(f"{label}_Keywords"),
        ]
    grouped = pairs.groupBy("call_id", "group_id", "speaker", "text").agg(*columns)
    kept = [c for c in grouped.columns if c not in ("call_id", "group_id", "speaker", "text")]
    return grouped.select("call_id", F.col("group_id").cast("string").alias("group_id"), "speaker", F.col("text").alias("call_text"), F.lit("NO").alias("system_audio_recording"), *[F.col(f"`{c}`") for c in kept])


def view_with_system(view: DataFrame, calls: DataFrame) -> DataFrame:
    """The view with a row for each row of a system recording, which hits nothing and has no scores."""
    hits = [c for c in view.columns if c.endswith("_Hit")]
    system = calls.filter("is_system").select(
        "call_id", F.concat(F.lit("SYS_"), F.col("row_idx").cast("string")).alias("group_id"), "speaker", t.text_or_empty(F.col("text")).alias("call_text"), F.lit("YES").alias("system_audio_recording"),
        *[F.lit("NO").alias(c) for c in hits],
    )
    return view.unionByName(system, allowMissingColumns=True)
