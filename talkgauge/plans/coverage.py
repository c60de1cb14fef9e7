"""Coverage of all calls in one plan: from transcripts and scripts to results and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.config import Settings
from talkgauge.operators import grouping, layout, matching, reports, rollup
from talkgauge.operators import scripts as scripting
from talkgauge.operators.embedding import Embedder
from talkgauge.operators.tfidf import gram_weights, inverse_frequencies, vectors, weighted_cosine
from talkgauge.schemas import require


@dataclass
class Coverage:
    """One language's calls against the script sheets that their tasks name.

    ``calls``: call_id, row_idx, speaker, text, start_time, end_time; ``tasks``: call_id, script_sheet, call_type and what
    routing adds; ``scripts``: sheet, script_row, point, standard_script, note. Every result is a lazy DataFrame.
    """

    calls: DataFrame
    tasks: DataFrame
    scripts: DataFrame
    settings: Settings = Settings()
    embedder: Embedder | None = None
    #: CAN's term weights: point, term, weight.
    terms: DataFrame | None = None
    #: Stored vectors: clean_text, embedding. With them each distinct text that has none is encoded once, for all calls.
    embeddings: DataFrame | None = None

    def __post_init__(self):
        require(self.calls, "call_id", "row_idx", "speaker", "text", "start_time", "end_time")
        require(self.tasks, "call_id", "script_sheet", "call_type")
        require(self.scripts, "sheet", "script_row", "point", "standard_script")

    @cached_property
    def flagged(self) -> DataFrame:
        """All rows with ``is_system``, which only sales calls can have."""
        s = self.settings
        rows = grouping.flag_system_audio(self.calls, s.main_speakers, s.min_run, s.min_run, s.min_mean_chars)
        kinds = self.tasks.select("call_id", "call_type").distinct()
        return rows.join(kinds, "call_id").withColumn("is_system", F.col("is_system") & (F.col("call_type") == "Sales Call")).drop("call_type")

    @cached_property
    def groups(self) -> DataFrame:
        s = self.settings
        rows = grouping.analysed_rows(self.flagged, include_system=s.include_system_audio)
        sheets = self.tasks.select("call_id", F.col("script_sheet").alias("sheet"))
        return grouping.dialogue_groups(rows, s.max_group_chars, s.short_group_chars, s.legacy_nan_text).join(sheets, "call_id")

    @cached_property
    def points(self) -> DataFrame:
        s = self.settings
        return scripting.points(scripting.composite_points(self.scripts, s.composite_sheets), s.language, s.split_before_clean)

    @cached_property
    def pairs(self) -> DataFrame:
        """Every group with every point of its sheet; results and views share it."""
        cosines = self.tfidf_cosines(self.terms) if self.terms is not None else None
        return matching.pairwise(self.groups, self.points, self.settings, self.embedder, cosines, self.embeddings).persist()

    @cached_property
    def coverage(self) -> DataFrame:
        return matching.coverage(self.pairs, self.settings)

    @cached_property
    def detailed(self) -> DataFrame:
        return reports.detailed_coverage(self.coverage)

    @cached_property
    def kpis(self) -> DataFrame:
        return reports.coverage_kpis(self.coverage, self.calls)

    @cached_property
    def speakers(self) -> DataFrame:
        return reports.speaker_stats(self.flagged, self.settings.language)

    @cached_property
    def sentences(self) -> DataFrame:
        return grouping.sentence_level(self.calls, self.groups)

    def view(self, sheet: str) -> DataFrame:
        """Groups by points of one sheet, with system rows; the sheet's points are the columns."""
        names = [row[0] for row in self.points.filter(F.col("sheet") == sheet).orderBy("point_order").select("point").collect()]
        own = self.pairs.filter(F.col("sheet") == sheet)
        calls = self.flagged.join(self.tasks.filter(F.col("script_sheet") == sheet).select("call_id"), "call_id", "left_semi")
        return reports.view_with_system(reports.call_view(own, names, self.settings.cut), calls)

    @cached_property
    def summary(self) -> DataFrame:
        return rollup.call_summary(self.tasks, self.kpis, reports.role_counts(self.speakers))

    def reports(self, names: DataFrame) -> DataFrame:
        """The calls' workbooks as laid-out rows; ``names``: call_id, report."""
        sheets = [row[0] for row in self.tasks.select("script_sheet").distinct().orderBy("script_sheet").collect()]  # script sheets, not calls
        return layout.call_reports(names, self.kpis, self.speakers, self.detailed, [self.view(sheet) for sheet in sheets], self.sentences)

    def tfidf_cosines(self, terms: DataFrame) -> DataFrame:
        """``call_id, group_id, point, pos, cosine``: the weighted TF-IDF cosine of groups and script texts (pos -1 is the holistic text).

        Each call's vocabulary is that of its human rows and of its sheet's variations. ``terms``: point, term, weight.
        """
        from talkgauge import lexicon
        from talkgauge.functions import text as t
        from talkgauge.functions import tokens as k

        language = self.settings.language
        tokens = lambda x: k.business_tokens(k.segment(t.clean(t.text_or_empty(x), language), language), language)
        rows = grouping.analysed_rows(self.flagged).select("call_id", F.concat(F.lit("r"), F.col("row_idx").cast("string")).alias("doc"), tokens(F.col("text")).alias("tokens"))
        texts = self.points.select("sheet", "point", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.col("holistic").alias("x"))), F.transform("variations", lambda v, i: F.struct(i.alias("pos"), v.alias("x"))))).alias("v"))
        texts = texts.select("sheet", "point", "v.pos", tokens(F.col("v.x")).alias("tokens"))
        sheets = self.tasks.select("call_id", F.col("script_sheet").alias("sheet"))
        scripts = sheets.join(texts, "sheet").withColumn("right_id", F.concat_ws("/", "point", F.col("pos").cast("string")))
        corpus = rows.unionByName(scripts.filter("pos >= 0").select("call_id", F.concat(F.lit("s"), F.col("right_id")).alias("doc"), "tokens"))
        idf = inverse_frequencies(corpus)
        left = vectors(self.groups.select("call_id", F.col("group_id").alias("left_id"), tokens(F.col("text")).alias("tokens")), ["call_id", "left_id"], idf)
        right = vectors(scripts.select("call_id", "right_id", "point", "tokens"), ["call_id", "right_id", "point"], idf)
        found = weighted_cosine(left, right, gram_weights(terms, lexicon.stopwords(language)))
        return found.select("call_id", F.col("left_id").alias("group_id"), "point", F.element_at(F.split("right_id", "/"), -1).cast("int").alias("pos"), "cosine")
