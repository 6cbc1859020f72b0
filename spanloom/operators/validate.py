"""Contract of tagger records: every broken rule of a record, as an array of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import remove_spans, spans_fit
from ..schema import ATTACK_TYPES, CUT_TYPES, POSITIONS, SPLITS, TEXT_FIELDS


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def rules() -> dict[str, Column]:
    """Code of each rule and the condition under which it is broken. Conditions are never null."""
    c = F.col
    spans, text = c("drop_spans"), c("attacked_data")
    fit = spans.isNotNull() & text.isNotNull() & F.coalesce(spans_fit(text, spans), F.lit(False))
    clean = F.coalesce(c("attack_type") == "Clean", F.lit(False))
    attacked = F.coalesce(c("attack_type").isin(ATTACK_TYPES[1:]), F.lit(False))
    has = fit & (F.size(spans) > 0)
    first = F.get(spans, F.lit(0))
    known = lambda column, domain: F.coalesce(c(column).isin(domain), F.lit(False))
    is_ = lambda x: F.coalesce(x, F.lit(False))
    return {
        **{f"null_{f}": c(f).isNull() for f in TEXT_FIELDS},
        "null_drop_spans": spans.isNull(),
        "split": c("split").isNotNull() & ~known("split", SPLITS),
        "attack_type": c("attack_type").isNotNull() & ~known("attack_type", ATTACK_TYPES),
        "position": c("position").isNotNull() & ~known("position", POSITIONS),
        "cut_type": c("cut_type").isNotNull() & ~known("cut_type", CUT_TYPES),
        "empty_id": is_((c("id") == "") | (c("base_id") == "")),
        "spans": spans.isNotNull() & text.isNotNull() & ~fit,
        "clean_spans": clean & is_(F.size(spans) > 0),
        "clean_injection": clean & (~_blank("injection") | ~_blank("inserted_text")),
        "clean_labels": clean & is_((c("position") != "none") | (c("cut_type") != "none")),
        "clean_text": clean & is_(text != c("clean_data")),
        "attack_spans": attacked & is_(F.size(spans) == 0),
        "attack_injection": attacked & (_blank("injection") | _blank("inserted_text")),
        "attack_position": attacked & is_(c("position") == "none"),
        "first_span": attacked & has & is_(F.substring(text, first["start"] + 1, first["end"] - first["start"]) != c("inserted_text")),
        "inserted_text": attacked & is_(~c("inserted_text").contains(c("injection"))),
        "round_trip": attacked & has & is_(remove_spans(text, spans) != c("clean_data")),
    }


def validated(records: DataFrame) -> DataFrame:
    """The records with ``errors``, the codes of the broken rules in the order of ``rules()``."""
    checks = [F.when(broken, F.lit(code)) for code, broken in rules().items()]
    return records.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def strict(records: DataFrame) -> DataFrame:
    """The records; reading one with a broken rule fails the query."""
    checked = validated(records)
    ok = F.when(F.size("errors") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("broken rules: "), F.array_join("errors", ", "))).cast("boolean"))
    return checked.where(ok).drop("errors")
