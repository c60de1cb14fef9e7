"""Columns of the inputs. Rows of a DataFrame have no order, so a call's rows carry ``row_idx``."""

from __future__ import annotations

from pyspark.sql import DataFrame

CALLS = "call_id string, row_idx long, speaker string, text string, start_time string, end_time string"
SCRIPTS = "sheet string, script_row long, point string, standard_script string, note string"
MAPPING = "sample_no string, product_name string, call_type string, map_row long"
TERMS = "language string, product string, point string, term string, weight double"
EMBEDDINGS = "clean_text string, embedding array<float>"

TRANSCRIPT_FILE = {"Speaker Roles": "speaker", "Transcription": "text", "Segment Start Time": "start_time", "Segment End Time": "end_time"}
SCRIPT_FILE = {"Required_Discussion_Point": "point", "Standard_Script": "standard_script", "Points to Note": "note"}


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The frame itself; an error that names the columns it lacks."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
