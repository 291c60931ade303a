"""Column expressions for text, labels and dates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, control separators included.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

# Label vocabularies, and the parts of words that decide compound labels, in order of precedence.
EXACT_LABELS = {
    "hawkish": ("hawkish", "hawk", "tightening", "restrictive", "positive", "label_2", "2"),
    "dovish": ("dovish", "dove", "easing", "accommodative", "negative", "label_0", "0"),
    "neutral": ("neutral", "mixed", "balanced", "label_1", "1"),
}
PART_LABELS = {
    "hawkish": ("hawk", "tight", "restrict"),
    "dovish": ("dov", "ease", "accommod"),
    "neutral": ("neutral", "mixed", "balance"),
}
PREDICTED_LABELS = {
    "hawkish": (("hawk", "positive"), ("label_2", "2")),
    "dovish": (("dov", "negative"), ("label_0", "0")),
}
BOILERPLATE_TITLES = ("", "html", "pdf", "board of governors of the federal reserve system")


def normalize(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends; null gives the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def text_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def record_id(source: Column, source_record_id: Column, event_date: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, source_record_id.cast("string"), event_date), 256), 1, 16)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def first_text(columns: Iterable[Column]) -> Column:
    """The first that is not blank, stripped; else the empty text."""
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def first_number(columns: Iterable[Column]) -> Column:
    """The first that is not empty, as a double; null where it is no number, or there is none."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns]).try_cast("double")


def event_date(raw: Column, year: Column | None = None) -> Column:
    """Eight digits are a date, four a year's first day, other values stay as they are; blank ones take a four-digit year."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    dashed = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    known = F.when(F.length(digits) == 8, dashed).when(F.length(digits) == 4, F.concat(digits, F.lit("-01-01"))).otherwise(raw)
    blank = F.coalesce(raw, F.lit("")) == ""
    from_year = F.lit("") if year is None else F.when(year.rlike("^[0-9]{4}$"), F.concat(year, F.lit("-01-01"))).otherwise("")
    return F.when(blank, from_year).otherwise(known)


def document_type(raw: Column) -> Column:
    cleaned = F.lower(normalize(raw))
    return F.when(cleaned.isin("0", "minutes"), "minutes").when(cleaned.isin("1", "statement"), "statement").when(cleaned == "", "unknown").otherwise(cleaned)


def label_origin(label: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) == "", "pseudo").otherwise("human")


def clean_label(raw: Column) -> Column:
    return F.replace(F.lower(normalize(raw)), F.lit("-"), F.lit("_"))


def _holds(text: Column, parts: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def map_label(raw: Column) -> Column:
    """The taxonomy's label: by whole words first, then by parts; null where nothing fits."""
    label = clean_label(raw)
    out = F.when(label == "", F.lit(None).cast("string"))
    for name, exact in EXACT_LABELS.items():
        out = out.when(label.isin(*exact), name)
    for name, parts in PART_LABELS.items():
        out = out.when(_holds(label, parts), name)
    return out


def map_prediction(raw: Column) -> Column:
    """A classifier's label; what is not known is neutral."""
    label = F.replace(F.lower(strip(F.coalesce(raw, F.lit("")))), F.lit("-"), F.lit("_"))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, (parts, exact) in PREDICTED_LABELS.items():
        out = out.when(_holds(label, parts) | label.isin(*exact), name)
    return out.otherwise("neutral")


def signal_label(raw: Column) -> Column:
    """The dashboard's reading, which differs from map_prediction on LABEL_1."""
    label = F.upper(F.coalesce(raw, F.lit("")))
    return F.when(_holds(label, ("POSITIVE", "LABEL_1")), "Hawkish").when(_holds(label, ("NEGATIVE", "LABEL_0")), "Dovish").when(label == "", "Unknown").otherwise(label)


def is_valid_date(raw: Column) -> Column:
    """Year of four digits, month and day with or without padding, and a day that exists."""
    return F.coalesce(raw.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & F.try_to_date(raw, "yyyy-M-d").isNotNull(), F.lit(False))


def iso_date(raw: Column) -> Column:
    """yyyy-MM-dd as a date; anything else is an error of the query, which names the value."""
    day = F.when(raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    return F.when(raw.isNotNull() & day.isNull(), F.raise_error(F.concat(F.lit("not a date as yyyy-MM-dd: "), raw)).cast("date")).otherwise(day)


def meeting_type(title: Column, body: Column) -> Column:
    both = F.lower(F.concat_ws(" ", title, body))
    return F.when(both.contains("unscheduled"), "Unscheduled").when(both.contains("scheduled"), "Scheduled").otherwise("Regular")


def long_date(text: Column) -> Column:
    """The first "Month d, yyyy" in a text as an ISO date; null if there is none."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    found = F.nullif(F.regexp_extract(text, rf"(?i)((?:{months})\s+[0-9]{{1,2}},\s+[0-9]{{4}})", 1), F.lit(""))
    return F.try_to_date(F.initcap(F.regexp_replace(found, r"\s+", " ")), "MMMM d, yyyy").cast("string")


def date_from_url(url: Column, prefix: str = "fomcminutes") -> Column:
    return F.coalesce(F.try_to_date(F.nullif(F.regexp_extract(url, rf"{prefix}([0-9]{{8}})", 1), F.lit("")), "yyyyMMdd").cast("string"), F.lit(""))


def document_title(title: Column, kind: Column, url: Column, date: Column) -> Column:
    """Boilerplate titles give way to one made of the kind and the document's or the address's date."""
    cleaned = normalize(title)
    known = F.coalesce(F.nullif(date, F.lit("")), F.nullif(date_from_url(url), F.lit("")))
    made = F.concat_ws(" ", F.lit("FOMC"), kind, known)
    return F.when(F.lower(cleaned).isin(*BOILERPLATE_TITLES), made).otherwise(cleaned)


def horizon_steps(horizon: Column, default: int = 3) -> Column:
    """Nd is N steps, one at least; anything else the default."""
    n = F.nullif(F.regexp_extract(F.lower(F.coalesce(horizon, F.lit(""))), "^([0-9]+)d$", 1), F.lit("")).try_cast("int")
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(default)))


def timestamp_day(raw: Column) -> Column:
    """What stands before the first plus sign."""
    return F.split_part(raw, F.lit("+"), F.lit(1))


def finite_or_null(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None).cast("double")).otherwise(value)


def error_tone(kind: Column, value: Column, baseline: Column) -> Column:
    share = F.when(baseline > 0, F.try_divide(value, baseline) * 100).otherwise(value)
    by_mape = F.when(value <= 2, "low").when(value <= 5, "medium").otherwise("high")
    by_rmse = F.when(share <= 1, "low").when(share <= 2.5, "medium").otherwise("high")
    return F.when(finite_or_null(value).isNull(), "neutral").when(kind == "mape", by_mape).otherwise(by_rmse)
