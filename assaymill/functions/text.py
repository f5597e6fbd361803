"""How numbers and metrics appear on a page: forms, normalisation, attribution, parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaymill.config import METRIC_WORDS, MONEY_METRICS

# How amounts and shares are printed, and what makes a page one with numbers.
MONEY = r"\$\s?(\d+(?:,\d{3})*(?:\.\d+)?)\s*([KMBkmb])?"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
NUMERIC = r"\d+(\.\d+)?\s?%|\$\s?\d"


def normalise(text: Column) -> Column:
    """Dashes to hyphens, no-break spaces to spaces, ``8.4 M`` to ``8.4M``, ``$ 8`` to ``$8``, one space for many."""
    t = F.translate(text, "–—− ", "--- ")
    t = F.regexp_replace(t, r"(\d)\s+([%KM])", "$1$2")
    t = F.regexp_replace(t, r"\$\s+(\d)", r"\$$1")
    return F.regexp_replace(t, r"\s+", " ")


def lower_each(text: Column) -> Column:
    """Lower case, each character by itself: one for one, whatever stands beside it."""
    return F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))


def upper_each(text: Column) -> Column:
    """Upper case, each character by itself; one that would become several (``ß``) stays as it is."""
    each = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    return F.array_join(each, "")


def _decimals(value: Column, places: int) -> Column:
    return F.round(value, places).cast(f"decimal(38,{places})").cast("string")


def _short(value: Column) -> Column:
    """Six significant digits at most, without trailing zeros."""
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.when(value != 0, F.abs(value)).otherwise(1.0))))
    d = (F.round(value * scale, 0) / scale).cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(d, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def money_forms(value: Column) -> Column:
    """Every accepted way to print an amount of whole dollars."""
    sign = F.when(value < 0, "-").otherwise("")
    a = F.abs(value)
    dollars = F.concat(sign, F.lit("$"), a.cast("long").cast("string"))
    grouped = F.concat(sign, F.lit("$"), F.format_number(a.cast("long"), 0))
    m = a / 1e6
    head = F.concat(sign, F.lit("$"))
    millions = F.array(
        F.concat(head, _decimals(m, 1), F.lit("M")),
        F.concat(head, _decimals(m, 2), F.lit("M")),
        F.concat(head, _short(m), F.lit("M")),
        F.concat(head, _decimals(m, 1), F.lit(" million")),
        F.concat(head, _short(m), F.lit(" million")),
    )
    k = F.round(a / 1e3, 0).cast("long")
    thousands = F.array(
        F.concat(head, k.cast("string"), F.lit("K")), F.concat(head, F.format_number(k, 0), F.lit("K"))
    )
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.array(grouped, dollars),
            F.when(a >= 1e6, millions).otherwise(none),
            F.when((a >= 1e3) & (a < 1e7), thousands).otherwise(none),
        )
    )


def percent_forms(value: Column) -> Column:
    shown = F.array(_decimals(value, 0), _decimals(value, 1), _short(value))
    return F.array_distinct(
        F.flatten(F.transform(shown, lambda s: F.array(F.concat(s, F.lit("%")), F.concat(s, F.lit(" %")), F.concat(s, F.lit(" percent")))))
    )


def surface_forms(metric: Column, value: Column) -> Column:
    """Forms by the metric's kind; any other value as it prints."""
    return (
        F.when(metric.isin(MONEY_METRICS), money_forms(value))
        .when(metric.endswith("_pct"), percent_forms(value))
        .otherwise(F.array(value.cast("string")))
    )


def _bound(value: Column, use) -> Column:
    """use(value), with the value made once: in a lambda it would be made again for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def folded(text: Column) -> Column:
    """The normalised text in lower case, in which forms and names are looked for."""
    return F.lower(normalise(text))


def value_present(text: Column, forms: Column) -> Column:
    """Whether any form is a part of the text, whatever its case. ``2%`` is a part of ``12%``."""
    return present_in(folded(text), forms)


def present_in(hay: Column, forms: Column) -> Column:
    """As :func:`value_present`, for a text that is folded already."""
    return _bound(hay, lambda h: F.exists(forms, lambda f: F.contains(h, folded(f))))


def value_present_strict(text: Column, forms: Column) -> Column:
    """As :func:`value_present`, but not inside a longer number."""
    hay = F.lower(normalise(text))

    def quoted(f: Column) -> Column:
        return F.regexp_replace(F.lower(normalise(f)), r"([$.%])", r"\\$1")

    return F.exists(forms, lambda f: F.regexp_like(hay, F.concat(F.lit(r"(^|[^0-9.,$])"), quoted(f), F.lit(r"($|[^0-9])"))))


def attributed(text: Column, metric: Column) -> Column:
    """Whether the text names the metric."""
    return named_in(folded(text), metric)


def named_in(hay: Column, metric: Column) -> Column:
    """As :func:`attributed`, for a text that is folded already."""
    words = F.create_map(*[x for k, v in METRIC_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    named = _bound(hay, lambda h: F.exists(F.element_at(words, metric), lambda w: F.contains(h, w)))
    return F.coalesce(named, F.lit(False))


def names(hay: Column, metric: str) -> Column:
    """As :func:`named_in`, for one metric that is known beforehand: no list is walked for a row."""
    return reduce(lambda a, b: a | b, [F.contains(hay, F.lit(w)) for w in METRIC_WORDS[metric]])


def amount(digits: Column, unit: Column) -> Column:
    """The number of a matched amount: commas removed, K, M or B applied."""
    times = F.when(F.lower(unit) == "k", 1e3).when(F.lower(unit) == "m", 1e6).when(F.lower(unit) == "b", 1e9).otherwise(1.0)
    return F.replace(digits, F.lit(","), F.lit("")).cast("double") * times


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct runs of three or more letters a-z, lower-cased, without stop words."""
    return F.array_except(
        F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{3,}"), 0)), F.array(*map(F.lit, stop))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members, three decimals; 0 when both are empty."""
    return F.coalesce(
        F.round(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), 3), F.lit(0.0)
    )


def has_term(text: Column, term: str) -> Column:
    """A part of the text, or a whole word if the term stands between bars."""
    if term.startswith("|"):
        return F.regexp_like(text, F.lit(rf"(^|[^a-z0-9_]){term.strip('|')}($|[^a-z0-9_])"))
    return F.contains(text, F.lit(term))


def clean_line(line: Column) -> Column:
    """Without anchors, one space for many."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"<!--co-[^>]+-->", ""), r"\s+", " "))
