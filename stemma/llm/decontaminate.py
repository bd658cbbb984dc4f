"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts and benchmark items become templates: words lose punctuation and case, and numbers, units
after numbers and names within a sentence become typed placeholders. Windows of ``WINDOW`` template
words (the whole item, where it is shorter) are hashed and joined on the hash. Of the windows that
agree at one shift between text and item, the slots must be consistent: a benchmark value that
stands in several slots has one value in the text. Windows with a slot where it hasn't don't count,
unless all their words are the item's own. So an item whose numbers or names were changed is found,
a text that merely has slots at the same places isn't. A document is contaminated by an item if
windows that agree are ``COVERAGE`` hundredths of the item's windows, or if more than ``COVERAGE``
hundredths of the item's words stand in windows that agree. For the words, items of 8 to 16 words
have shorter windows besides, of just under half the item and ``LEAST_RUN`` words at least: whatever
single word of an item of 11 words or more is replaced, the rest is found. Of shorter items, a
replaced word in the middle leaves too little. ``coverage`` is the share of windows.

The item windows are broadcast only if there are ``BROADCAST_ROWS`` at most; beyond that the join
shuffles by hash, where AQE splits hot ones.

Nulls: null texts have no words; null doc_ids and item_ids are never contaminated nor contaminate.
Items under ``LEAST_WORDS`` words match nothing. Very long texts: whole. Repeated rows: rows of one
doc_id are one document. Ties between items: the smallest item_id. An empty benchmark: nothing is
contaminated. Other columns are kept by ``drop_contaminated`` and not read by ``contamination``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import let, stored, words_of

WINDOW, LEAST_WORDS, COVERAGE = 8, 4, 50
#: Words of the shorter windows at least.
LEAST_RUN = 5
#: Windows of items that are broadcast: some 50 bytes each.
BROADCAST_ROWS = 500_000
# fixed values: units of measure
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar c f k usd eur gbp dollar dollars euro euros pound pounds cent cents percent mph kmh kb mb gb tb"
).split()
_NUMBER = r"^[^\p{L}\p{N}]*\p{N}+([.,:/\-]\p{N}+)*[^\p{L}\p{N}]*$"
_MEASURE = r"^[^\p{L}\p{N}]*\p{N}+([.,]\p{N}+)*(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")[^\p{L}\p{N}]*$"
_NAME = r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}"
_STOP = r"""[.!?:;]["')\]]*$"""


def core(word: Column) -> Column:
    """Letters and digits of a word, in lower case."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]+", "")


def template_word(words: Column, word: Column, i: Column) -> Column:
    before = F.get(words, i - 1)
    measure = F.rlike(F.lower(word), F.lit(_MEASURE))
    return (
        F.when(F.rlike(word, F.lit(r"\p{N}")), F.when(F.rlike(word, F.lit(_NUMBER)), F.lit("<num>")).when(measure, F.lit("<num><unit>")).otherwise(core(word)))
        .when(core(word).isin(UNITS) & (i > 0) & F.rlike(before, F.lit(_NUMBER)), F.lit("<unit>"))
        .when((i > 0) & F.rlike(word, F.lit(_NAME)) & ~F.rlike(before, F.lit(_STOP)), F.lit("<name>"))
        .otherwise(core(word))
    )


def template_hashes(text: Column) -> Column:
    """A hash for each word of the template."""
    return let(words_of(text), lambda w: F.transform(w, lambda x, i: F.xxhash64(template_word(w, x, i))))


def slots(text: Column) -> Column:
    """(pos, value) of the slots of a text's template; the value is the word's letters and digits."""

    def found(w: Column) -> Column:
        every = F.transform(w, lambda x, i: F.struct(i.alias("pos"), core(x).alias("value"), F.startswith(template_word(w, x, i), F.lit("<")).alias("is_slot")))
        return F.filter(every, lambda s: s["is_slot"])

    return let(words_of(text), found)


def windows(hashes: Column, size: int) -> Column:
    """The hashes of all windows of ``size`` words, in order."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(F.lit(size), x, *(F.get(hashes, i + k) for k in range(1, size))))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n_words, full (words of a window), short (of one for the words), size, ipos, h, n_windows (of those of ``full`` words) and the slots in each window."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), template_hashes(F.col(text_col)).alias("hs"), slots(F.col(text_col)).alias("slots"))
    items = items.withColumn("n_words", F.size("hs")).where(F.col("n_words") >= LEAST_WORDS).withColumn("full", F.least("n_words", F.lit(WINDOW)))
    half = F.greatest(F.lit(LEAST_RUN), F.floor((F.col("n_words") - 1) / 2).cast("int"))
    items = items.withColumn("short", F.least("full", half)).withColumn("n_windows", F.col("n_words") - F.col("full") + 1)
    items = items.withColumn("size", F.explode(F.array_distinct(F.array("full", F.when(F.col("n_words") >= WINDOW, F.col("short")).otherwise(F.col("full"))))))
    by_size = F.when(F.col("size") == WINDOW, windows(F.col("hs"), WINDOW))
    for size in range(LEAST_WORDS, WINDOW):
        by_size = by_size.when(F.col("size") == size, windows(F.col("hs"), size))
    kept = ("item_id", "n_words", "full", "short", "size", "n_windows")
    out = items.withColumn("ws", by_size).select(*kept, "slots", F.posexplode("ws").alias("ipos", "h"))
    inside = F.filter("slots", lambda s: (s["pos"] >= F.col("ipos")) & (s["pos"] < F.col("ipos") + F.col("size")))
    return out.select(*kept, "ipos", "h", F.transform(inside, lambda s: F.struct(s["pos"].alias("pos"), s["value"].alias("value"))).alias("slots"))


def words_covered(starts: Column, size: Column) -> Column:
    """How many words windows of ``size`` words at these sorted starts hold."""
    new = F.transform(starts, lambda x, i: F.least(size, F.coalesce(F.get(starts, i + 1) - x, size)))
    return F.aggregate(new, F.lit(0), lambda n, x: n + x)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each contaminated doc_id: n_items, and of the item that is covered most item_id and coverage."""
    items = item_windows(benchmark)
    facts = items.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes"), F.max(F.size("slots") > 0).alias("slots")).first()
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sizes = sorted(facts["sizes"] or [WINDOW])
    found = let(template_hashes(F.col("text")), lambda hs: F.flatten(F.array(*(F.transform(windows(hs, s), lambda h, i: F.struct(h.alias("h"), i.alias("pos"))) for s in sizes))))
    found = named.select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.h", "w.pos")
    hits = found.join(F.broadcast(items) if facts["n"] <= BROADCAST_ROWS else items, "h")
    hits = hits.select("doc_id", "item_id", "n_words", "full", "short", "size", "ipos", "n_windows", (F.col("pos") - F.col("ipos")).alias("shift"), "slots")
    if facts["slots"]:
        hits = stored(hits, "hits")  # used three times; and with its size known, the slots of other documents aren't looked at
        asking = hits.where(F.size("slots") > 0).select("doc_id").distinct()
        values = named.join(asking, "doc_id", "left_semi").select("doc_id", F.explode(slots(F.col("text"))).alias("s")).select("doc_id", F.col("s.pos").alias("pos"), F.col("s.value").alias("found"))
        at = ["doc_id", "item_id", "shift"]
        asked = hits.select(*at, F.explode("slots").alias("s")).select(*at, F.col("s.pos").alias("ipos"), (F.col("shift") + F.col("s.pos")).alias("pos"), F.col("s.value").alias("value")).distinct()
        wrong = F.collect_list(F.when(F.col("found") != F.col("value"), F.col("ipos")))
        by_value = asked.join(values, ["doc_id", "pos"]).groupBy(*at, "value").agg(F.min("found").alias("a"), F.max("found").alias("b"), wrong.alias("wrong"))
        clash = by_value.groupBy(*at).agg(F.collect_list(F.when(F.col("a") != F.col("b"), F.col("value"))).alias("clashing"), F.flatten(F.collect_list("wrong")).alias("wrong")).where(F.size("clashing") > 0)
        hits = hits.join(clash, at, "left")
        clashes = F.exists("slots", lambda s: F.array_contains(F.col("clashing"), s["value"]))
        other = F.exists("slots", lambda s: F.array_contains(F.col("wrong"), s["pos"]))
        hits = hits.where(F.col("clashing").isNull() | ~(clashes & other))
    item = ["doc_id", "item_id", "n_words", "full", "short", "n_windows"]
    covered = hits.select(*item, "size", "ipos").distinct().groupBy(*item).agg(F.count(F.when(F.col("size") == F.col("full"), 1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("size") == F.col("short"), F.col("ipos")))).alias("starts"))
    words = words_covered(F.col("starts"), F.col("short"))
    leaked = covered.where((100 * F.col("n") >= COVERAGE * F.col("n_windows")) | (100 * words > COVERAGE * F.col("n_words"))).withColumn("coverage", F.col("n") / F.col("n_windows"))
    best = F.min_by(F.struct("item_id", "coverage"), F.struct(-F.col("coverage"), F.col("item_id")))
    return leaked.groupBy("doc_id").agg(F.count("*").alias("n_items"), best.alias("best")).select("doc_id", "n_items", "best.item_id", "best.coverage")


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, item_id, coverage, contaminated and kept for each row of ``docs``."""
    found = contamination(docs, benchmark)
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "item_id", "coverage", F.col("n_items").isNotNull().alias("contaminated"), F.col("n_items").isNull().alias("kept"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    gone = stored(contamination(docs, benchmark).select("doc_id"), "leaked")  # of a known size: where it is small, no text is shuffled
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
