"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that carry no meaning for retrieval.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def query_tokens(c: Column) -> Column:
    """Tokens of more than one character."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))


def one_and_two_grams(t: Column) -> Column:
    """An array of tokens, then each two that stand side by side."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.concat(t, F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def content_tokens(c: Column) -> Column:
    """Query tokens that are no stop words."""
    return F.filter(query_tokens(c), lambda t: ~t.isin(STOP_WORDS))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]+>", ""))


# The character references that are decoded, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def strip_html(c: Column) -> Column:
    """Decode references, turn tags to spaces, collapse white space."""
    for a, b in ENTITIES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\f]+", " "))


def clip(c: Column, n: int) -> Column:
    """Collapsed text, cut to n characters."""
    return F.substring(squeeze(c), 1, n)


def assemble(title: Column, body: Column, limit: int = 2400) -> Column:
    """Title, an empty line, and as much of the body as the limit leaves."""
    room = F.lit(limit) - F.length(title) - 2
    return F.concat(title, F.lit("\n\n"), body.substr(F.lit(1), F.greatest(room, F.lit(0))))


def normalize_title(c: Column) -> Column:
    """Lower case without a trailing dash part, a trailing parenthesis or trailing marks."""
    c = F.regexp_replace(F.lower(F.trim(c)), " - [^,]*$", "")
    c = F.regexp_replace(c, "\\s*\\([^)]*\\)\\s*$", "")
    return F.trim(F.regexp_replace(c, "[,.;:]+$", ""))


def slug_tokens(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[-_./]+", " ")))


def enrich(*parts: Column) -> Column:
    """The parts that are not empty, each once without regard to case, joined by a dash."""
    kept = F.filter(F.array(*(F.trim(p) for p in parts)), lambda p: p.isNotNull() & (p != ""))
    first = F.filter(kept, lambda p, i: F.array_position(F.transform(kept, F.lower), F.lower(p)) == i + 1)
    return F.array_join(first, " — ")


# Currency marks.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "RM": "MYR"}


def salary(c: Column) -> Column:
    """(low, high, currency) of a pay range such as `$1,200 - 1,500`; null where there is none."""
    pattern = r"(RM|[$€£])\s*([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*-\s*(?:RM|[$€£])?\s*([0-9][0-9,]*(?:\.[0-9]+)?))?"
    low, high = (F.replace(F.regexp_extract(c, pattern, i), F.lit(","), F.lit("")).try_cast("double") for i in (2, 3))
    mark = F.create_map(*(F.lit(x) for pair in CURRENCIES.items() for x in pair))
    return F.struct(low.alias("low"), F.coalesce(high, low).alias("high"), F.try_element_at(mark, F.regexp_extract(c, pattern, 1)).alias("currency"))


def recent(ts: Column, cutoff: Column) -> Column:
    """Not before the cutoff; a time that is missing or unreadable is kept."""
    return F.coalesce(F.try_to_timestamp(ts) >= cutoff, F.lit(True))


def remote(locations: Column) -> Column:
    return F.exists(locations, lambda x: F.lower(x).rlike("remote|anywhere"))


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(label)) for p, label in rules))


def coverage(q: Column, d: Column) -> Column:
    """The share of distinct query tokens that the document has."""
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, d)) / F.size(F.array_distinct(q)))


def jaccard(q: Column, d: Column) -> Column:
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, d)) / F.greatest(F.size(F.array_union(q, d)), F.lit(1)))


def bigrams(t: Column) -> Column:
    """Adjacent pairs of tokens."""
    return F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def skeleton(c: Column) -> Column:
    """First letter, then consonants, runs collapsed."""
    return F.regexp_replace(F.concat(F.substring(c, 1, 1), F.translate(F.substr(c, F.lit(2)), "aeiouy", "")), "(.)\\1+", "$1")


def capped_distance(a: Column, b: Column) -> Column:
    """Edit distance of at most 4; lengths that differ by more than 3 count as 4."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 3, F.lit(4)).otherwise(F.least(F.levenshtein(a, b), F.lit(4)))


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(h > 0, F.concat(h, F.lit("h "), F.lpad(m.cast("string"), 2, "0"), F.lit("m")))
        .when(m > 0, F.concat(m, F.lit("m "), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def l2_to_cosine(d: Column) -> Column:
    return 1 - d / 2


def verdict(response: Column) -> Column:
    """The verdict of a judge's answer: its first VERDICT line, else any of the words, else uncertain."""
    line = F.upper(F.regexp_extract(response, r"(?im)^\s*VERDICT:(.*)$", 1))
    of = lambda c: F.coalesce(*(F.when(c.contains(w), F.lit(w)) for w in ("EXACT", "RELATED", "IRRELEVANT", "UNCERTAIN")))
    return F.coalesce(F.when(line != "", of(line)), of(F.upper(response)), F.lit("UNCERTAIN"))


def clean_suggestion(c: Column) -> Column:
    """Whether a phrase may be shown as a completion."""
    return (F.length(c) >= 2) & (F.size(F.split(F.trim(c), " +")) <= 7) & ~c.rlike(r"[0-9]{5,}|[_/\\|<>{}#]|  ")


def negated(c: Column) -> Column:
    """Words that a phrase excludes: after without, not, no, non, except, free of; and before -free."""
    after = F.regexp_extract_all(F.lower(c), F.lit(r"\b(?:without|not|no|non|except|excluding|free of)[ -]+(?:a |an |the |any )?([a-z]{3,})"), F.lit(1))
    before = F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z]{3,})[ -]free\b"), F.lit(1))
    return F.filter(F.array_distinct(F.concat(after, before)), lambda t: ~t.isin(STOP_WORDS))


def inversion_cause(c: Column) -> Column:
    """Why a query may rank a wrong answer first; the order of the rules matters."""
    q = F.lower(c)
    model = q.rlike("(^| )[a-z0-9-]*[0-9][a-z0-9-]*( |$)") & q.rlike("[a-z]")
    return (
        F.when(q.rlike(r"\b(without|not|no|non|except)\b"), "negation")
        .when(q.rlike(r"\b(best|good|cheap|nice|gift|cool|top)\b"), "abstract")
        .when(model, "model_number")
        .when(F.size(tokens(q)) >= 4, "compound_spec")
        .otherwise("ambiguous")
    )


def log_odds(yes: Column, no: Column, floor: float = -20.0) -> Column:
    """Log-odds of two log-probabilities, missing ones at the floor."""
    return F.coalesce(yes, F.lit(floor)) - F.coalesce(no, F.lit(floor))


def expected_grade(pairs: Column) -> Column:
    """Σ grade·p / Σ p over array<struct<grade, logprob>>."""
    p = F.transform(pairs, lambda x: F.exp(x["logprob"]))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    up = F.aggregate(F.zip_with(pairs, p, lambda x, y: x["grade"] * y), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, up / total)


def lead(article: Column) -> Column:
    """What stands before the first heading (== Title ==), trimmed; all, if there is none."""
    return F.btrim(F.regexp_extract(article, r"(?s)\A(.*?)(?:^={2,6}[^=\n][^\n]*={2,6}[ \t]*$|\z)".replace("(?s)", "(?sm)"), 1), F.lit(" \t\n\r"))


def section(article: Column, titles: tuple[str, ...]) -> Column:
    """The text below the first heading of one of these titles, up to the next heading that is not deeper; empty if there is none."""
    names = "|".join(titles)
    body = rf"(?smi)^(={{2,6}})[ \t]*(?:{names})[ \t]*\1[ \t]*$(.*?)(?:^(?!\1=)={{2,6}}[^=\n][^\n]*=[ \t]*$|\z)"
    return F.btrim(F.regexp_extract(article, body, 2), F.lit(" \t\n\r"))
