"""Texts that were cut, at a fixed length or on the way.

Per source, the discrete hazard of ending at each length is tested against the hazards of neighbouring
lengths, with false-discovery control; lengths are counted in characters and bytes, and also within
blocks of common sizes. How a text ends is then weighed: the line it stops in against the last lines of
whole files and against the lines in which files stop that are cut anywhere, and its last word against
the words of the corpus. The hazard at its length gives the prior odds; or else the share of cut texts among those
that end with the same mark of a cut, which line ends after it tell; or else the rate at which its source loses the
rest of texts at no special length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.common import let, shelve, strip
from noteweave.llm.discovery import with_q_values

# Marks that a cut may leave at the very end, and block sizes of storage and transfer.
MARKS = ["…", "[cut]", "[truncated]", "[...]", "<truncated>", "�", "..."]
BLOCKS = [512, 1000, 1024, 4096]
_MARK_END = r"(?:(?:" + "|".join(re.escape(m) for m in MARKS) + "))++$"

#: Lengths at most so far away are neighbours.
REACH = 64
#: Share of false discoveries among the lengths at which a source cuts.
FALSE_DISCOVERIES = 0.01
#: Places at which every whole text is cut to learn how cut texts end.
TRIAL_CUTS = 4
#: First guesses of the share of cut texts, and of whole texts that lack their last line end.
FIRST_RATE, LACKING = 0.02, 0.15
#: Share of the weight of shapes seen once that any one new shape has.
NEW = 0.01
#: Symbols at the start and at the end of a line's shape that are told apart.
SHAPE = (3, 6)
#: Lengths are put into ranges of so many, each with its neighbours, so that a task sees one range only.
SPAN = 4096
#: Prefixes of longer words are found by sorting instead of listing them.
LONG_WORD = 64


def _ending(text: Column) -> Column:
    """struct<nl,shape,word> of the end of a text: whether it ends a line, the shape of all of its last line (without
    up to two line ends), and the word it stops in."""

    def of(core: Column) -> Column:
        line = F.substring_index(core, "\n", -1)
        shape = F.regexp_replace(line, r"^[ \t]+", ">")
        for pattern, symbol in ((r"(?<!\s)\s++$", "_"), (r"[\p{L}_][\p{L}\p{N}_]*", "w"), (r"\p{N}[\p{L}\p{N}_.]*", "9"), (r"w(?:,? w)++", "W"), (r"\s+", " ")):
            shape = F.regexp_replace(shape, pattern, symbol)
        return F.struct(F.concat(F.left(shape, F.lit(SHAPE[0])), F.lit("~"), F.right(shape, F.lit(SHAPE[1]))).alias("shape"), F.lower(F.regexp_extract(line, r"(?<!\p{L})(\p{L}++)$", 1)).alias("word"))

    def tail(last: Column) -> Column:
        nl = last.endswith("\n")
        return let(of(F.regexp_replace(last, r"\r?\n$", "")), lambda e: F.struct(nl.alias("nl"), e["shape"].alias("shape"), F.when(~nl, e["word"]).alias("word")))

    return let(F.substring_index(text, "\n", -3), tail)  # the last line and two line ends after it


def _features(docs: DataFrame, key: str, text: str, source: str, lang: str) -> DataFrame:
    """A row per text that isn't blank: its lengths, its ending, and how it ends where it is cut on trial. ``mark`` tells
    the mark at the end of its last line, and whether a blank stands before it, by a number, -1 for none; ``bare`` is
    how it ends before its marks."""
    body = docs.where(strip(F.col(text)) != "").select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("t"))
    chars = F.length("t")
    last = F.substring_index(F.regexp_replace(F.substring_index("t", "\n", -2), r"\r?\n$", ""), "\n", -1)
    which = reduce(lambda c, i: c.when(last.endswith(MARKS[i]), i), range(1, len(MARKS)), F.when(last.endswith(MARKS[0]), 0)).otherwise(-1)
    marked = F.when(which >= 0, let(F.regexp_replace(last, _MARK_END, ""), lambda core: F.struct((which * 2 + F.when(core.rlike(r"\s$"), 1).otherwise(0)).alias("mark"), _ending(core).alias("bare"))))
    places = F.array(*(1 + F.pmod(F.xxhash64("t", F.lit(i)), F.greatest(chars - 1, F.lit(1))) for i in range(TRIAL_CUTS)))
    cuts = F.transform(places, lambda p: _ending(F.substring(F.col("t"), F.lit(1), p.cast("int"))))
    return body.select(
        "key", "source", "lang", chars.cast("long").alias("chars"), F.octet_length("t").cast("long").alias("bytes"), F.xxhash64("t").alias("content"), marked.alias("m"), _ending(F.col("t")).alias("end"), cuts.alias("cuts")
    ).select("*", F.coalesce("m.mark", F.lit(-1)).alias("mark"), "m.bare").drop("m")


def _mark_rates(features: DataFrame) -> dict[int, float]:
    """For each mark the share of cut texts among those that end with it and with no line end after it.

    Whole texts that end with a mark mostly have a line end after it, as whole texts do; as many of them lack it as
    of all texts do. What there is beyond that was cut; one text more may be either, so that few settle nothing."""
    rows = features.groupBy("mark", "end.nl").agg(F.count("*").alias("n")).collect()  # two rows per mark
    n = {(r["mark"], r["nl"]): r["n"] for r in rows}
    lacking = sum(k for (_, nl), k in n.items() if not nl) / max(sum(k for (_, nl), k in n.items() if nl), 1)
    return {m: (max(k - n.get((m, True), 0) * lacking, 0) + 0.5) / (k + 1) for (m, nl), k in n.items() if m >= 0 and not nl}


def _units(f: DataFrame) -> Column:
    """All measures of a text's length: array<struct<unit,length,wrap>>; wrap is the block, 0 for plain lengths."""
    measure = lambda unit, value, wrap=0: F.struct(F.lit(unit).alias("unit"), value.alias("length"), F.lit(wrap).cast("long").alias("wrap"))
    return F.array(measure("chars", F.col("chars")), measure("bytes", F.col("bytes")), *(measure(f"{kind} in blocks of {b}", F.col(kind) % b, b) for kind in ("chars", "bytes") for b in BLOCKS))


def length_hazards(features: DataFrame, *, reach: int = REACH) -> DataFrame:
    """source, unit, length, n, at_risk, hazard, expected, log10_p, q_value: a row per length that occurs.

    ``n`` counts different texts that end at ``length``, so copies of a file don't count as a habit of the
    source; ``at_risk`` those of at least that length, in blocks all; ``hazard`` is their ratio. The hazard of
    the lengths within ``reach``, those at which no text ends included, is their ends over their risks, pooled;
    ``expected`` is that hazard times ``at_risk``. Blocks wrap around.

    Lengths are counted before they are measured in other units, and windows see ``SPAN`` lengths and their
    neighbours only, so that no task holds all lengths of a source.
    """
    texts = features.groupBy("source", "content", "chars", "bytes").agg(F.lit(1)).groupBy("source", "chars", "bytes").agg(F.count("*").alias("n"))
    counts = texts.select("source", "n", F.explode(_units(texts)).alias("u")).groupBy("source", "u.unit", "u.wrap", "u.length").agg(F.sum("n").alias("n")).withColumn("span", F.floor(F.col("length") / SPAN))
    counts = shelve(counts, "lengths")
    spans = counts.groupBy("source", "unit", "wrap", "span").agg(F.sum("n").alias("k"))
    above = F.sum("k").over(Window.partitionBy("source", "unit").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("source", "unit", "span", F.coalesce(above, F.lit(0)).alias("beyond"))
    # a length is also a neighbour in the ranges beside its own; a block's first and last ones are beyond its other end too
    length, span, wrap = F.col("length"), F.col("span"), F.col("wrap")
    seat = lambda at, span, own: F.struct(at.alias("at"), span.cast("long").alias("span"), F.lit(own).alias("own"))
    beside = F.array_compact(F.array(F.when(length - span * SPAN < reach, seat(length, span - 1, False)), F.when((span + 1) * SPAN - length <= reach, seat(length, span + 1, False))))
    around = F.array_compact(F.array(F.when(length < reach, seat(length + wrap, span, False)), F.when(wrap - length <= reach, seat(length - wrap, span, False))))
    seats = counts.select("source", "unit", "wrap", "length", "n", F.explode(F.concat(F.array(seat(length, span, True)), F.when(wrap > 0, around).otherwise(beside))).alias("s")).select("source", "unit", "wrap", "length", "n", "s.*")
    seats = seats.join(spans, ["source", "unit", "span"])  # a range without lengths of its own asks for no neighbours
    by = Window.partitionBy("source", "unit", "span")
    near, at = by.orderBy("at").rangeBetween(-reach, reach), F.col("at")
    first = F.greatest(F.lit(1), at - reach)
    own_n = F.when(F.col("own"), F.col("n")).otherwise(0)
    seen = seats.withColumns({
        "at_risk": F.when(wrap > 0, F.sum(own_n).over(by)).otherwise(F.col("beyond") + F.sum(own_n).over(by.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))),
        "ends": F.sum("n").over(near), "up": F.sum("n").over(by.orderBy("at").rangeBetween(Window.currentRow, reach)), "places": F.sum(F.col("n") * at).over(near),
    }).where("own")
    # a text that ends at k within reach is at risk up to k there; one that ends beyond is at risk at all places
    risks = (F.col("at_risk") - F.col("up")) * (at + reach - first + 1) + F.col("places") - F.col("ends") * (first - 1)
    others = F.when(wrap > 0, F.col("at_risk") * 2 * reach).otherwise(risks - F.col("at_risk"))
    pooled = (F.col("ends") - F.col("n") + 0.5) / F.greatest(others, F.lit(1))
    seen = seen.withColumns({"hazard": F.col("n") / F.col("at_risk"), "expected": F.col("at_risk") * pooled})

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield d.assign(log10_p=poisson_tail(d["n"].to_numpy(), d["expected"].to_numpy()))

    schema = "source string, unit string, wrap long, length long, n long, at_risk long, hazard double, expected double, log10_p double"
    tested = shelve(seen.select(*(c.split()[0] for c in schema.split(", ")[:-1])).mapInPandas(test, schema), "hazards")
    return with_q_values(tested, tested.count())


def poisson_tail(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """log10 P(K >= n) of Poisson variables, by the series from n on, or its complement below the mean."""
    out = np.zeros(len(n))
    high = n > mean
    k, m = n[high].astype(float), mean[high]
    log_first = k * np.log(m) - m - np.array([_log_factorial(x) for x in k])
    total, term, i = np.ones(len(k)), np.ones(len(k)), 0
    while len(k) and term.max() > 1e-12 and i < 100_000:
        i += 1
        term = term * m / (k + i)
        total += term
    out[high] = np.minimum(0, (log_first + np.log(total)) / np.log(10))
    return out


def _log_factorial(x: float) -> float:
    return math.lgamma(x + 1)


def _ending_odds(features: DataFrame) -> DataFrame:
    """key, source, mark, word, odds: how much likelier each ending is for a text cut anywhere than for a whole one.

    Texts that end with a line end teach how whole texts end, and trial cuts of all texts how cut texts do. Whole
    texts without a last line end have endings of their own (minified code never has one): so texts without
    it also teach, with the weight of being whole that a first round gives their ending, but none about itself.
    """
    ended = features.where("mark < 0").groupBy("lang", F.col("end.shape").alias("shape")).agg(F.count_if("end.nl").alias("closed"), F.count_if(~F.col("end.nl")).alias("open"))
    trial = features.select("lang", F.explode("cuts").alias("c"))
    cut = trial.groupBy("lang", F.col("c.shape").alias("shape")).agg(F.count_if(F.col("c.nl")).alias("cut_closed"), F.count_if(~F.col("c.nl")).alias("cut_open"))
    table = ended.join(cut, ["lang", "shape"], "full").na.fill(0)
    table = shelve(table.withColumns({"cut_all": F.col("cut_open") + F.col("cut_closed")}), "shapes")
    shape, lang = Window.partitionBy("shape"), Window.partitionBy("lang")

    def shares(t: DataFrame, *names: str, out_of: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, float]]:
        """``p_<name>``: the share of a shape within its language, drawn towards its share in all, and for shapes
        never seen by how often shapes are new: the number of those seen once. Also that share of a new shape alone."""
        out_of = {n: (out_of or {}).get(n, n) for n in names}
        by_shape = t.groupBy("shape").agg(*(F.sum(c).alias(c) for c in {*out_of, *out_of.values()}))
        once = [F.count_if((F.col(n) > 0) & (F.col(n) <= 1)).alias(f"s_{n}") for n in out_of]
        total = by_shape.agg(*(F.sum(c).alias(f"t_{c}") for c in set(out_of.values())), *once).collect()[0]  # one row
        t_of = {n: max(float(total[f"t_{of}"] or 0), 1.0) for n, of in out_of.items()}
        new = {n: NEW * (total[f"s_{n}"] + 1) / t_of[n] for n in out_of}
        return t.select("*", *((0.9 * F.col(n) / F.greatest(F.sum(of).over(lang), F.lit(1)) + 0.1 * F.sum(n).over(shape) / t_of[n] + new[n]).alias(f"p_{n}") for n, of in out_of.items())), new

    first, new = shares(table, "closed", "cut_open", "cut_closed", out_of={"cut_open": "cut_all", "cut_closed": "cut_all"})
    first = first.withColumn("open_whole", F.greatest(F.col("open") - 1, F.lit(0)) / (1 + FIRST_RATE * F.col("p_cut_open") / (LACKING * F.col("p_closed"))))
    first = shelve(first.withColumn("lacking", F.col("open_whole") + LACKING * F.col("closed")), "lacking")
    held = first.agg(F.sum("open_whole").alias("open"), F.sum("closed").alias("closed")).collect()[0]  # one row
    lack = min(max((held["open"] or 0) / max((held["open"] or 0) + (held["closed"] or 0), 1), 0.02), 0.98)
    model, new_lacking = shares(first, "lacking")
    new |= new_lacking
    model = model.select("lang", "shape", (F.col("p_cut_open") / (F.col("p_lacking") * lack)).alias("open_odds"), (F.col("p_cut_closed") / (F.col("p_closed") * (1 - lack))).alias("closed_odds"))
    ends = features.select("key", "source", "lang", "mark", "end.nl", "end.shape", "end.word")
    # only endings before a mark can be new here
    odds = F.when(F.col("nl"), F.coalesce("closed_odds", F.lit(new["cut_closed"] / (new["closed"] * (1 - lack))))).otherwise(F.coalesce("open_odds", F.lit(new["cut_open"] / (new["lacking"] * lack))))
    return ends.join(model, ["lang", "shape"], "left").select("key", "source", "mark", "word", odds.alias("odds"))


def _word_odds(docs: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """word, word_odds: how much likelier it is to stop in or after ``word`` by a cut than at its end by intent."""
    tokens = docs.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    tokens = shelve(tokens, "tokens")
    mean = tokens.agg(F.sum(F.length("token") * F.col("n")) / F.sum("n")).collect()[0][0] or 1.0  # one value
    is_long = F.length("word") > LONG_WORD
    parts = tokens.select("n", "token", F.explode(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(LONG_WORD)))).alias("i")).select("n", F.left("token", F.col("i")).alias("word"), (F.col("i") == F.length("token")).alias("full"))
    # summed per prefix before any join: the shortest prefixes are few and have nearly all tokens
    summed = parts.groupBy("word").agg(F.sum("n").alias("any"), F.sum(F.when(F.col("full"), F.col("n")).otherwise(0)).alias("whole"))
    counts = summed.join(words.where(~is_long), "word", "left_semi").unionByName(_long_prefixes(tokens, words.where(is_long)))
    return counts.select("word", (F.greatest(F.col("any") - 0.5, F.lit(0.5)) / F.greatest(F.col("whole") - 0.5, F.lit(0.5)) / mean).alias("word_odds"))


def _long_prefixes(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """word, any, whole of words above ``LONG_WORD``: sorted by text, the tokens that begin with a word follow it."""
    head = lambda c: F.left(c, F.lit(LONG_WORD)).alias("head")
    last = F.concat("word", F.lit("\U0010ffff"))  # sorts after all that begins with the word
    marks = words.select(head("word"), F.col("word").alias("at"), "word", F.lit(-1).alias("side"), F.lit(0).alias("n")).unionByName(words.select(head("word"), last.alias("at"), "word", F.lit(1).alias("side"), F.lit(0).alias("n")))
    rows = marks.unionByName(tokens.where(F.length("token") > LONG_WORD).select(head("token"), F.col("token").alias("at"), F.col("token").alias("word"), F.lit(0).alias("side"), "n"))
    so_far = F.sum("n").over(Window.partitionBy("head").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = rows.withColumn("so_far", so_far).groupBy("word").agg(
        F.max(F.when(F.col("side") == 1, F.col("so_far"))).alias("upto"), F.max(F.when(F.col("side") == -1, F.col("so_far"))).alias("before"), F.sum("n").alias("whole")
    )
    return summed.where("upto is not null").select("word", (F.col("upto") - F.col("before")).alias("any"), "whole")


def fit_rates(counts: pd.DataFrame, *, rounds: int = 500) -> pd.DataFrame:
    """EM for one source: the share of texts cut at no special length. ``counts``: source, log_odds (binned), n."""
    odds, n = np.exp(counts["log_odds"].to_numpy(float)), counts["n"].to_numpy(float)
    rate = 0.02
    for _ in range(rounds):
        new = float((n * rate * odds / (rate * odds + 1 - rate)).sum() / n.sum())
        if abs(new - rate) < 1e-9:
            break
        rate = new
    return pd.DataFrame({"source": [counts["source"].iloc[0]], "rate": [rate]})


def find_truncated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", false_discoveries: float = FALSE_DISCOVERIES, reach: int = REACH) -> DataFrame:
    """``key``, source, probability, at_limit of every text that isn't blank: how surely it was cut.

    ``at_limit`` names the measure under which its source significantly often ends at this length, null if
    there is none. Null and blank texts are left out: nothing tells whether they were cut. Null sources and
    languages are one of their own; repeated rows are judged alike; other columns are ignored.
    """
    features = shelve(_features(docs, key, text, source, lang), "endings")
    # what whole texts end with as often is no mark; before others the text itself is looked at
    marks = {m: rate for m, rate in _mark_rates(features).items() if rate > 0.5}
    real = F.col("mark").isin(*marks) & ~F.col("end.nl") if marks else F.lit(False)
    features = features.withColumns({"mark": F.when(real, F.col("mark")).otherwise(-1), "end": F.when(real, F.col("bare")).otherwise(F.col("end"))})
    hazards = length_hazards(features, reach=reach)
    # odds of a cut at such a length, from the least excess that two standard errors leave; a handful of texts proves no habit
    odds = (F.col("n") - F.col("expected") - 2 * F.sqrt("n")) / (F.col("expected") + 0.5)
    limits = hazards.where((F.col("q_value") <= false_discoveries) & (odds > 1)).select("source", "unit", "length", odds.alias("limit_odds"))
    at = features.select("key", "source", F.explode(_units(features)).alias("u")).select("key", "source", "u.unit", "u.length").join(limits, ["source", "unit", "length"])
    at = at.groupBy("key").agg(F.max(F.struct("limit_odds", "unit")).alias("limit"))
    ends = shelve(_ending_odds(features), "odds")
    words = ends.where("word <> ''").select("word").distinct()
    # texts that don't stop in a word, which are most, take no part in the join
    stopped = ends.where("word <> ''").join(_word_odds(docs, text, words), "word", "left")
    judged = stopped.unionByName(ends.where("coalesce(word, '') = ''"), allowMissingColumns=True).select("key", "source", "mark", (F.log("odds") + F.coalesce(F.log("word_odds"), F.lit(0.0))).alias("log_odds"))
    judged = shelve(judged.join(at, "key", "left"), "judged")
    bins = judged.where("limit is null and mark < 0").groupBy("source", F.round("log_odds", 1).alias("log_odds")).agg(F.count("*").alias("n"))
    rates = bins.groupBy("source").applyInPandas(fit_rates, "source string, rate double")
    of_mark = reduce(lambda c, m: c.when(F.col("mark") == m, math.log(marks[m] / (1 - marks[m]))), marks, F.when(F.lit(False), 0.0))
    prior = F.coalesce(F.log("limit.limit_odds"), of_mark, F.log(F.col("rate") / (1 - F.col("rate"))), F.lit(-20.0))
    return judged.join(rates, "source", "left").select(F.col("key").alias(key), "source", (1 / (1 + F.exp(-(F.col("log_odds") + prior)))).alias("probability"), F.col("limit.unit").alias("at_limit")).distinct()
