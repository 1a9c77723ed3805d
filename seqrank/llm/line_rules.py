"""Quality rules, line first: failing lines go, then documents that lose too much.

Every line of a text that holds a word is judged by three rules:

* *punctuation*: besides one mark, over ``PUNCTUATION_SHARE`` of its characters
  (without spaces) are punctuation or symbols, or it has fewer than ``SHORT_WORDS`` words and doesn't
  end like a sentence;
* *navigation*: over ``SEPARATOR_SHARE`` of its words are separators of menus, or
  it has more capitals than small letters and at least ``MENU_WORDS`` words;
* *boilerplate*: it has at most ``NOTICE_WORDS`` words and a phrase of page notices,
  or over ``ECHO_SHARE`` of its words repeat the word before.

Failing lines are taken out. A document is rejected if that takes more than
``MAX_LOSS`` of the characters of its words, or if the whole text fails a base
rule: fewer than ``MIN_WORDS`` words, or over ``MAX_REPEAT`` percent of them in
windows of ``WINDOW`` words that the text holds twice or more. Words of equal
64-bit hashes, and windows of equal ones, count as equal.

Everything is one expression per text: no shuffle, no Python. Null texts are
empty, empty texts have no words and fail the base rules; lines without a word
stay and lose nothing; repeated rows get equal results; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import let

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT = 30
MAX_LOSS = 0.3
PUNCTUATION_SHARE = 0.12
SHORT_WORDS = 4
SEPARATOR_SHARE = 0.15
MENU_WORDS = 3
NOTICE_WORDS = 40
ECHO_SHARE = 0.3

RULES = ("punctuation", "navigation", "boilerplate")

# Word separators and symbols of the base counts, ends of sentences,
# separators of menus, phrases of page notices.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
ENDS = "[.!?:;…。！？][\"'”’»)\\]]*$"
SEPARATORS = ("|", "||", "•", "·", "»", "›", ">", "/", "–", "—", "-", "→")
NOTICES = (
    "all rights reserved", "click here", "cookie policy", "cookies", "copyright ©", "enable javascript", "forgot password", "log in",
    "lorem ipsum", "powered by", "privacy policy", "read more", "share on", "sign in", "sign up", "skip to content", "subscribe", "terms of use",
)

_SPLIT = "[\\x20\\x09-\\x0D]+"


def _letters(text: Column, drop: str) -> Column:
    """Code points of a text without the characters of ``drop``."""
    return F.length(F.translate(text, drop, ""))


def _matched(text: Column, pattern: str) -> Column:
    """Code points that a pattern of single characters matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_rule(line: Column, words: Column, chars: Column) -> Column:
    """Number of the first rule that a line fails, from 1; 0 if it passes."""
    n = F.size(words)
    many = _matched(line, "[\\p{P}\\p{S}]+") - 1 > F.lit(PUNCTUATION_SHARE) * chars
    stub = (n < SHORT_WORDS) & ~F.rtrim(line).rlike(ENDS)
    menu = F.size(F.filter(words, lambda w: w.isin(*SEPARATORS))) > F.lit(SEPARATOR_SHARE) * n
    loud = (n >= MENU_WORDS) & (_matched(line, "\\p{Lu}+") > _matched(line, "\\p{Ll}+"))
    notice = (n <= NOTICE_WORDS) & F.lower(line).rlike("|".join(NOTICES))
    echo = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, F.greatest(i - 1, F.lit(0)))))) > F.lit(ECHO_SHARE) * n
    return F.when(n == 0, 0).when(many | stub, 1).when(menu | loud, 2).when(notice | echo, 3).otherwise(0)


def repeated_words(words: Column) -> Column:
    """Words that lie in windows which the array holds twice or more."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def twice(w: Column) -> Column:
        """Places of windows that an equal one precedes or follows in hash order."""
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["w"] == F.get(s, i)["w"], F.lit(False))
        return let(placed, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: same(s, i, i + 1) | ((i > 0) & same(s, i, F.greatest(i - 1, F.lit(0))))), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        ahead = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(ahead, F.lit(0), lambda a, x: a + x)

    some = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(twice(w), covered)).otherwise(0)
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) > WINDOW, let(hashes, lambda h: let(windows(h), some))).otherwise(0).cast("long")


def judged(text: Column) -> Column:
    """A struct of the cleaned text, the base counts, the lines that each rule took, and the verdicts."""
    def line(x: Column) -> Column:
        words = F.filter(F.split(x, _SPLIT), lambda w: w != "")
        return let(words, lambda w: let(_letters(x, SPACES), lambda c: F.struct(
            x.alias("line"), w.alias("words"), c.alias("chars"), line_rule(x, w, c).alias("rule"))))

    def total(lines: Column, of) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + of(x))

    def counts(body: Column, lines: Column) -> Column:
        full = F.transform(F.filter(lines, lambda x: x["chars"] > 0), lambda x: x["line"])
        kept = F.filter(lines, lambda x: x["rule"] == 0)
        return F.struct(
            F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"),
            total(lines, lambda x: F.size(x["words"])).alias("n_words"),
            total(lines, lambda x: x["chars"]).alias("word_chars"),
            (F.length(body) - _letters(body, SYMBOLS)).cast("long").alias("n_symbols"),
            let(full, lambda f: (F.size(f) - F.size(F.array_distinct(f))).cast("long")).alias("n_dup_lines"),
            let(F.flatten(F.transform(lines, lambda x: x["words"])), repeated_words).alias("n_repeat_words"),
            *[total(lines, lambda x, i=i: (x["rule"] == i).cast("int")).alias(f"n_{name}") for i, name in enumerate(RULES, start=1)],
            total(lines, lambda x: F.when(x["rule"] > 0, x["chars"]).otherwise(0)).alias("lost_chars"),
        )

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT * c["n_words"])
        fine = c["lost_chars"] <= F.lit(MAX_LOSS) * c["word_chars"]
        return F.struct(c.alias("counts"), failed.alias("base_failed"), (~failed & fine).alias("kept"))

    body = F.coalesce(text, F.lit(""))
    return let(let(body, lambda b: let(F.transform(F.split(b, "\n"), line), lambda x: counts(b, x))), verdict)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TAKEN = (*(f"n_{name}" for name in RULES), "lost_chars")


def examine(docs: DataFrame, text: str = "text", out: str = "_rules") -> DataFrame:
    """``docs`` and a struct ``out``: ``counts`` (the cleaned ``text`` and all counts), ``base_failed``, ``kept``."""
    return docs.withColumn(out, judged(F.col(text)))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their failing lines taken out; columns as given."""
    return examine(docs, text).where("_rules.kept").withColumn(text, F.col("_rules.counts.text")).select(*docs.columns)


def _sql(value: str) -> str:
    return value.replace("'", "''")


def _drop_sql(column: str, characters: str) -> str:
    return f"length(translate({column}, {' || '.join(f'chr({ord(c)})' for c in characters)}, ''))"


# SQL twin of the query. Lines with the end mark of a text are cut at chr(10).
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, i, string_split(t, chr(10))[i] AS x FROM d, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(i)),
w AS (SELECT *, list_filter(string_split_regex(x, '{_SPLIT}'), lambda y: y <> '') AS ws, {_drop_sql('x', SPACES)} AS chars FROM l),
f AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0
    WHEN length(x) - length(regexp_replace(x, '[\\p{{P}}\\p{{S}}]+', '', 'g')) - 1 > {PUNCTUATION_SHARE} * chars
      OR len(ws) < {SHORT_WORDS} AND NOT regexp_matches(rtrim(x, ' '), '{_sql(ENDS)}') THEN 1
    WHEN len(list_filter(ws, lambda y: y IN ({', '.join(f"'{s}'" for s in SEPARATORS)}))) > {SEPARATOR_SHARE} * len(ws)
      OR len(ws) >= {MENU_WORDS} AND length(regexp_replace(x, '\\p{{Lu}}+', '', 'g')) < length(regexp_replace(x, '\\p{{Ll}}+', '', 'g')) THEN 2
    WHEN len(ws) <= {NOTICE_WORDS} AND regexp_matches(lower(x), '{'|'.join(NOTICES)}')
      OR len(list_filter(range(2, len(ws) + 1), lambda y: ws[y] = ws[y - 1])) > {ECHO_SHARE} * len(ws) THEN 3 ELSE 0 END AS rule FROM w),
a AS (SELECT r, sum(len(ws))::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars,
    (count(*) FILTER (chars > 0) - count(DISTINCT x) FILTER (chars > 0))::BIGINT AS n_dup_lines,
    {', '.join(f'(count(*) FILTER (rule = {i}))::BIGINT AS n_{n}' for i, n in enumerate(RULES, start=1))},
    coalesce(sum(chars) FILTER (rule > 0), 0)::BIGINT AS lost_chars, flatten(list(ws ORDER BY i)) AS ws FROM f GROUP BY r),
g AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], chr(10)) AS k FROM a, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i)),
h AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least({WINDOW}, coalesce(after - i, {WINDOW})))::BIGINT AS n FROM h GROUP BY r),
o AS (SELECT doc_id, {', '.join(f'a.{x}' for x in ('n_words', 'word_chars', 'n_dup_lines', *TAKEN))},
    (length(t) - {_drop_sql('t', SYMBOLS)})::BIGINT AS n_symbols, coalesce(c.n, 0) AS n_repeat_words FROM d JOIN a USING (r) LEFT JOIN c USING (r))
SELECT doc_id, {', '.join(COUNTS)}, {', '.join(TAKEN)},
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND lost_chars <= {MAX_LOSS} * word_chars AS kept FROM o"""
