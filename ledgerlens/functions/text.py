"""Scalar expressions: masking, redaction, normalization, tokens, confirmation intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"([ .,;:!?\n]|^|$)"

# Words that confirm, cancel or change a request. Cancelling is looked for first.
CANCEL = _EDGE + r"(no|cancel|stop|never mind|don't|nein|non)" + _EDGE
CHANGE = _EDGE + r"(actually|instead|change|wait|statt|plutôt)" + _EDGE
AFFIRM = _EDGE + r"(yes|yeah|confirm|go ahead|sure|ok|ja|oui|si)" + _EDGE


def mask(c: Column, keep: int = 4) -> Column:
    """All but the last characters as stars; values of up to keep characters become stars only."""
    return F.when(F.length(c) > keep, F.concat(F.lit("****"), F.right(c, F.lit(keep)))).otherwise(F.lit("****"))


def redact(c: Column) -> Column:
    """Addresses and runs of nine digits or more, out of logs."""
    return F.regexp_replace(F.regexp_replace(c, r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "[email]"), r"[0-9]{9,}", "[number]")


def normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r]+", " "))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def confirm_intent(c: Column) -> Column:
    """cancel, change, affirm or none. Cancel wins over change, change over affirm."""
    t = F.lower(c)
    return F.when(t.rlike(CANCEL), "cancel").when(t.rlike(CHANGE), "change").when(t.rlike(AFFIRM), "affirm").otherwise("none")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, null where whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
