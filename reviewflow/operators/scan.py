"""Pattern scans of whole texts and rule labels."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.functions.binding import let

# What a stored secret looks like (matched without case).
SECRET_PATTERNS = {
    "password": r"""password\s*=\s*["'][^"']+["']""",
    "api_key": r"""api_key\s*=\s*["'][^"']+["']""",
    "secret_key": r"""secret_key\s*=\s*["'][^"']+["']""",
    "token": r"""token\s*=\s*["'][^"']+["']""",
    "webhook_url": r"""webhook_url\s*=\s*["']https://hooks\.slack\.com[^"']+["']""",
    "database_url": r"""database_url\s*=\s*["']postgresql://[^"']+["']""",
    "openai_key": r"sk-[a-zA-Z0-9]{48}",
    "slack_token": r"xoxb-[0-9]+-[0-9]+-[a-zA-Z0-9]+",
}
# A text without the word cannot match the pattern; looking for the word is much cheaper.
SECRET_WORDS = {
    "password": "password", "api_key": "api_key", "secret_key": "secret_key", "token": "token",
    "webhook_url": "webhook_url", "database_url": "database_url", "openai_key": "sk-",
    "slack_token": "xoxb-",
}
# Words that mark a match as a placeholder.
PLACEHOLDERS = ("your_", "example", "placeholder", "xxx", "secret_here", "token_here")
# Query texts put together in unsafe ways (matched without case).
UNSAFE_QUERY_PATTERNS = {
    "f_string": r'f".*SELECT.*\{.*\}"',
    "percent_format": r'".*SELECT.*"\s*%\s*\(',
    "format_call": r"\.format\(.*SELECT",
    "concatenation": r"""execute\(["'].*\+""",
}
REPORT_CHARS = 50

# The labels and their order. The phrases are cues of this library, made up to stand in for a
# choice of a model.
LABEL_RULES = (
    ("No Guests", ("do not allow guests", "don't allow guests", "do not take guests",
                   "no guests")),
    ("Identity-based rejection", ("only accept women", "only accept men", "only feature female",
                                  "only feature women")),
    ("Topic-based rejection", ("only accept tech guests", "the podcast is about",
                               "not our topic")),
    ("Qualification-based rejection", ("only accept ceos", "followers", "only feature guests who",
                                       "in revenue")),
    ("Pay-to-Play", ("paid slots", "guest people who pay", "guest fee")),
    ("Conditional", ("a few questions first", "please answer the following",
                     "could you provide")),
    ("Accepted", ("love to have", "perfect for our show", "interested in having")),
)
OTHER_LABEL = "Others"


def _line_feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


# Put around matches; a text that holds it is cut at its matches a second time instead.
MARK = "\u0001"


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (type, place, line feeds before it since the last match, own line feeds, match).

    The pattern runs once: it sets a mark on either side of its matches, and the text is cut at the marks. Every
    second piece is a match.
    """
    regex = F.lit(f"(?i){pattern}")

    def cut(pieces: Column) -> Column:
        return F.struct(F.filter(pieces, lambda x, i: i % 2 == 1).alias("found"),
                        F.filter(pieces, lambda x, i: i % 2 == 0).alias("between"))

    def listed(parts: Column) -> Column:
        since = F.slice(F.transform(parts["between"], _line_feeds), F.lit(1), F.size(parts["found"]))
        return F.transform(F.arrays_zip(parts["found"].alias("match"), since.alias("since")),
                           lambda m, i: F.struct(F.lit(kind).alias("type"), i.alias("place"),
                                                 m["since"].alias("since"),
                                                 _line_feeds(m["match"]).alias("own"), m["match"].alias("match")))

    marked = F.split(F.regexp_replace(text, regex, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    twice = F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("found"),
                     F.split(text, f"(?i){pattern}", -1).alias("between"))
    return let(F.when(text.contains(MARK), twice).otherwise(let(marked, cut)), listed)


def scan_patterns(docs: DataFrame, patterns: dict[str, str] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", words: dict[str, str] | None = None) -> DataFrame:
    """Every match of every pattern: id, type, line, match.

    ``words`` names for a pattern a lower-case word that each of its matches holds; texts without
    it are not searched for that pattern. The line is a running count over the matches of a text, so a text
    with very many matches costs no more per match; only matches are shuffled.
    """
    patterns = UNSAFE_QUERY_PATTERNS if patterns is None else patterns
    words = words or {}
    none = F.array().cast("array<struct<type:string,place:int,since:int,own:int,match:string>>")

    def search(text, low):
        return F.concat(*[
            F.when(low.contains(words[kind]), _matches(text, kind, pattern)).otherwise(none)
            if kind in words else _matches(text, kind, pattern)
            for kind, pattern in patterns.items()])

    low = F.lower(text_col) if words else F.lit("")
    found = let(F.struct(F.col(text_col).alias("text"), low.alias("low")),
                lambda v: search(v["text"], v["low"]))
    numbered = docs.filter(F.col(text_col).isNotNull()) \
        .withColumn("_text", F.monotonically_increasing_id())
    hits = numbered.select(id_col, "_text", F.inline(found))
    so_far = Window.partitionBy("_text", "type").orderBy("place")
    line = F.lit(1) + F.sum(F.col("since") + F.col("own")).over(so_far) - F.col("own")
    return hits.select(id_col, "type", line.cast("int").alias("line"), "match")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in texts, without placeholders; the report shows the first 50 characters."""
    low = F.lower("match")
    real = F.lit(True)
    for word in PLACEHOLDERS:
        real = real & ~low.contains(word)
    shown = F.when(F.length("match") > REPORT_CHARS,
                   F.concat(F.substring("match", 1, REPORT_CHARS), F.lit("..."))) \
             .otherwise(F.col("match"))
    return scan_patterns(docs, SECRET_PATTERNS, id_col, text_col, SECRET_WORDS).filter(real) \
        .select(id_col, "type", "line", shown.alias("text"))


def classify_rules(df: DataFrame, rules=LABEL_RULES, text_col: str = "text",
                   out: str = "label") -> DataFrame:
    """The first label one of whose phrases is in the text, else ``Others``.

    A fixed stand-in for a label given by a model. The rules are a short list in the program, so
    they become one expression and need no join.
    """
    def choose(low):
        label = None
        for name, phrases in rules:
            hit = reduce(or_, [low.contains(phrase) for phrase in phrases])
            label = F.when(hit, name) if label is None else label.when(hit, name)
        return F.lit(OTHER_LABEL) if label is None else label.otherwise(OTHER_LABEL)

    return df.withColumn(out, let(F.lower(F.coalesce(text_col, F.lit(""))), choose))
