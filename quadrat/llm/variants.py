"""Spelling variants: words one edit apart, found with pivotal grams, and the form that each word varies.

All bigrams of the words are put in one order, rarest first. A word's prefix is its first three bigrams in this order (with
all places of the third); an edit changes at most two bigrams that overlap. Its pivots are two bigrams of the prefix that do
not overlap, chosen by dynamic programming so that few words hold them; an edit leaves one of them whole. So of two words one
edit apart the one whose prefix ends first in the order has a pivot that stands in the prefix of the other. The edit moves
it by at most one place, and only together with the length: the join is on bigram, length and place. Every pair that meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quadrat.session import stored

#: Runs of letters, and the letters that are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EDITS, GRAM = 1, 2

#: Where the part that agrees lies, and what the edit does to the length.
MOVES = tuple((side, longer) for side in ("start", "end") for longer in (0, 1, -1))


def spelled(doc_id: Column, run: Column, modulus: int) -> Column:
    """The lower-cased run, without one code point where ``modulus`` divides the checksum of id and run (NULL id: empty)."""
    low = F.translate(run, UPPER, LOWER)
    check = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low))
    place = (check % F.length(low)).cast("int")
    return F.when(check % modulus == 0, F.concat(F.substring(low, F.lit(1), place), F.substring(low, place + 2, F.length(low)))).otherwise(low)


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, modulus: int = 97) -> DataFrame:
    """Words of at least ``least_length`` code points that occur at least ``least_count`` times in all texts: word, n."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(spelled(F.col("doc_id"), F.col("run"), modulus).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def prefix(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, place) of the word's first ``GRAM * EDITS + 1`` bigrams in the order, and of further places of the last of them."""
    grams = sorted((order[word[i:i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = grams[min(GRAM * EDITS, len(grams) - 1)][0]
    return [g for g in grams if g[0] <= last]


def pivots(grams: list[tuple[int, int]], cost: list[int]) -> list[tuple[int, int]]:
    """``EDITS + 1`` grams without overlap and with the least sum of costs, by dynamic programming over their places."""
    placed = sorted(grams, key=lambda g: g[1])
    best: list[list[tuple[int, list[tuple[int, int]]] | None]] = [[(cost[g[0]], [g]) for g in placed]]
    for _ in range(EDITS):
        row: list[tuple[int, list[tuple[int, int]]] | None] = []
        for i, g in enumerate(placed):
            ends = [best[-1][j] for j in range(i) if placed[j][1] <= g[1] - GRAM and best[-1][j]]
            least = min(ends, key=lambda e: e[0], default=None)
            row.append((least[0] + cost[g[0]], [*least[1], g]) if least else None)
        best.append(row)
    return min((e for e in best[-1] if e), key=lambda e: e[0])[1]


def _gram_order(words: DataFrame) -> tuple[dict[str, int], list[int]]:
    """Rank of every bigram, rarest first, and how many words' bigrams it is. The alphabet has 90 letters, so 8,100 at most."""
    places = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))
    found = words.select(F.explode(places).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "gram").collect()
    return {r.gram: k for k, r in enumerate(found)}, [r.n for r in found]


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs a < b of ``words`` (distinct, at least four code points, letters of ``RUN``) exactly one insertion, deletion
    or replacement apart: a, a_n, b, b_n."""
    order, cost = _gram_order(words)

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            grams = [prefix(w, order) for w in df["word"]]
            chosen = [pivots(g, cost) for g in grams]
            yield pd.DataFrame({"word": df["word"], "n": df["n"], "last": [g[-1][0] for g in grams],
                                "prefix": [[{"gram": r, "place": i} for r, i in g] for g in grams],
                                "pivots": [[{"gram": r, "place": i} for r, i in c] for c in chosen]})

    kinds = "word string, n long, last int, prefix array<struct<gram:int,place:int>>, pivots array<struct<gram:int,place:int>>"
    planned = stored(words.mapInPandas(plan, kinds), "pivots").withColumn("length", F.length("word"))

    def part(side: Column) -> Column:
        """The word from its start to the gram's end, or from the gram to its end."""
        return F.when(side == "start", F.substring(F.col("word"), F.lit(1), F.col("g.place") + GRAM)).otherwise(
            F.substring(F.col("word"), F.col("g.place") + 1, F.col("length")))

    moves = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(n).alias("longer")) for s, n in MOVES))
    sides = F.array(F.lit("start"), F.lit("end"))
    asks = (planned.select("word", "n", "last", "length", F.explode("pivots").alias("g"))
            .select("word", "n", "last", "length", "g", F.explode(moves).alias("m"))
            .select(F.col("word").alias("p"), F.col("n").alias("p_n"), F.col("last").alias("p_last"), F.col("m.side").alias("side"),
                    part(F.col("m.side")).alias("part"), (F.col("length") + F.col("m.longer")).alias("length")))
    holds = (planned.select("word", "n", "last", "length", F.explode("prefix").alias("g"))
             .select("word", "n", "last", "length", "g", F.explode(sides).alias("side"))
             .select(F.col("word").alias("q"), F.col("n").alias("q_n"), F.col("last").alias("q_last"), "side", part(F.col("side")).alias("part"), "length"))
    met = asks.hint("merge").join(holds, ["side", "part", "length"]).where(
        (F.col("p_last") <= F.col("q_last")) & (F.levenshtein("p", "q", EDITS) == EDITS))
    first = F.col("p") < F.col("q")
    return met.select(F.least("p", "q").alias("a"), F.when(first, F.col("p_n")).otherwise(F.col("q_n")).alias("a_n"),
                      F.greatest("p", "q").alias("b"), F.when(first, F.col("q_n")).otherwise(F.col("p_n")).alias("b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) without NULLs or rings: word and the last form that it leads to, by pointer doubling."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        seen = Observation()
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(further, "root", "left").observe(seen, F.count("next").alias("n"))
        now = stored(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")
        if not seen.get["n"]:
            return now


def group_variants(docs: DataFrame, ratio: int = 2, least_length: int = 5, least_count: int = 3, modulus: int = 97) -> DataFrame:
    """Words of all whole texts with the form each of them varies: word, form, root, n, n_near, form_n.

    The form is the near word with the most occurrences (ties: the first in code-point order) if these are at least ``ratio``
    times the word's own, else NULL; the root is the end of the chain of forms, the word itself if it has none. A NULL or
    empty text has no words; a row that repeats counts again; a NULL id is spelled as the empty string; other columns are not
    read. No words, or an empty table, give an empty result. ``least_length`` is 4 at least.
    """
    words = stored(count_words(docs, least_length, least_count, modulus), "words")
    pairs = stored(near_pairs(words), "near")
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = (pairs.select(F.explode(ways).alias("w")).select("w.*").groupBy("word")  # no more rows than letters times places
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("first")))
    strong = -F.col("first.least") >= ratio * F.col("n")
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("first.near")).alias("form"), F.when(strong, -F.col("first.least")).alias("form_n"))
    known = stored(known, "forms")
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _checksum_steps() -> list[int]:
    """What the reflected polynomial of crc32 makes of every byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


#: The rows of ``group_variants`` on ``documents`` with its default parameters.
SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
         lambda s, b: xor(s >> 8, {_checksum_steps()}[CAST(xor(s, b) & 255 AS INTEGER) + 1])), 4294967295::BIGINT) AS h FROM counted),
spelled AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word
  FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
shorter AS (SELECT word, n, i, left(word, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.rest),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
                row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.root WHERE e.form IS NULL
"""
