"""Benchmark decontamination by template canonicalisation, in DataFrame and SQL functions only.

Numbers, units after numbers, and names (capitalised words inside a sentence) become typed placeholders, the rest is
lower-cased; the words of a text keep their number and places. Windows of words are hash-joined in two forms: of the
template, where the item's window holds ``LITERALS`` literal words, from every word of both sides; and of the lower-cased
words as they are, without that condition, from every word of an item and every ``step``-th of a document, since a run of
``window + step - 1`` words holds at least one such window. Each hit is then followed along its diagonal: the longest run
of words that are equal in either form and whose slots are consistent, that is, one value of the item always stands for
one value of the document, must be ``RUN`` words, or the whole of a shorter item. So a question whose numbers or names
were exchanged is still found, and every verbatim copy is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Words of a window, words of a run that counts, literal words that a window needs.
WINDOW, RUN, LITERALS = 8, 13, 5
#: Windows or documents up to which a hash table is broadcast (16 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000

_WORDS = "[\\\\x20\\\\x09-\\\\x0D]+"
# a cheap look at the next character comes before each look-behind
_NUMBER = "(?=[-+0-9])(?<![\\\\p{L}\\\\p{N}])[+-]?[0-9]+(?:[.,:/][0-9]+)*"
_UNIT = "(<num>[ ]?)(?:mm|cm|km|m|mg|kg|g|ml|l|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inch(?:es)?|pounds?|lbs?|tons?|litres?|liters?|metres?|meters?|grams?|dollars?|euros?|cents?|percent|%|€|[$]|°[CF]?)(?![\\\\p{L}\\\\p{N}])"
_NAME = "\\\\p{Lu}(?<=[\\\\p{Ll},;][ ]\\\\p{Lu})\\\\p{Ll}+"


def spaced(text: str) -> str:
    """SQL of ``text`` with single spaces for its runs of white space, none at its ends."""
    return f"trim(regexp_replace({text}, '{_WORDS}', ' '))"


def template(spaced_text: str) -> str:
    """SQL of the canonical form of a spaced text."""
    numbers = f"CASE WHEN {spaced_text} RLIKE '[0-9]' THEN regexp_replace(regexp_replace({spaced_text}, '{_NUMBER}', '<num>'), '{_UNIT}', '$1<unit>') ELSE {spaced_text} END"
    return f"lower(regexp_replace({numbers}, '{_NAME}', '<name>'))"


def word_array(spaced_text: str) -> str:
    """SQL of the words of a spaced text; none of an empty one."""
    return f"CASE WHEN {spaced_text} = '' THEN cast(array() AS array<string>) ELSE split({spaced_text}, ' ') END"


def _value(word: str) -> str:
    return f"lower(regexp_replace({word}, '^[\\\\p{{P}}]+|[\\\\p{{P}}]+$', ''))"


def _slot(word: str) -> str:
    return f"({word} LIKE '%<num>%' OR {word} LIKE '%<name>%' OR {word} LIKE '%<unit>%')"


def _places(size: int, step: int) -> str:
    return f"CASE WHEN size(words) >= {size} THEN sequence(0, size(words) - {size}, {step}) ELSE cast(array() AS array<int>) END"


def _hashed(places: str, words: str, size: int) -> str:
    return f"transform({places}, i -> struct(i AS at, xxhash64(slice({words}, i + 1, {size})) AS hash))"


def _doc_windows(size: int, step: int) -> str:
    """SQL of (word position from 0, hash) of a document's windows: of the plain words at every ``step``-th place, and of
    the template at every place from which a run may reach one of those windows, where that one holds a placeholder
    (without one both forms are equal, and the plain window finds the run)."""
    held = f"filter({_places(size, step)}, a -> slice(words, a + 1, {size}) <> slice(raw, a + 1, {size}))"
    near = f"array_distinct(flatten(transform({held}, a -> sequence(greatest(0, a - {step - 1}), least(size(words) - {size}, a + {step - 1})))))"
    return f"{_hashed(_places(size, step), 'raw', size)}, {_hashed(near, 'words', size)}"


def _item_windows(words: str, last: str, literals: int) -> str:
    """SQL of the same of an item, up to the place ``last``; a shorter item is one window."""
    part = f"slice({words}, i + 1, {WINDOW})"
    return f"transform(filter(sequence(0, {last}), i -> size(filter({part}, w -> NOT {_slot('w')})) >= least({literals}, size({words}))), i -> struct(i AS at, xxhash64({part}) AS hash))"


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if ``rows``, its checked size, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, at (the run's first word), run_words, item_words, n_slots, n_changed.

    Equal items are one, named by their smallest item_id. A null text or one without words holds nothing and is held by
    nothing; rows with a null doc_id or item_id are not compared. Rows that repeat a doc_id are one document: a hit in
    any of them counts. Windows of fewer literal words than ``LITERALS`` (or than a shorter item has) are looked for word
    for word only. An item's first word may be a name or not. Where a contradicting slot cuts a run, RUN words of it are
    reported (or the item's, if fewer). Other columns are not read. An empty benchmark finds nothing.
    """
    text = F.expr(spaced("cast(text AS string)")).alias("text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("whole"), text).where("item_id IS NOT NULL AND text <> ''")
    items = items.groupBy("whole").agg(F.min("item_id").alias("item_id"), F.first("text").alias("text"))
    items = items.select("item_id", "text", F.expr(word_array("lower(text)")).alias("raw"), F.expr(word_array(template("text"))).alias("words"))
    inside = f"slice({word_array(template("concat('a ', text)"))}, 2, 1)"  # the first word's form within a sentence
    items = cut(items.select("item_id", "raw", "words", F.expr(f"concat({inside}, slice(words, 2, size(words)))").alias("inner")), "template-items", few=True)
    shape = items.agg(F.min(F.expr(f"CASE WHEN size(words) >= {WINDOW} THEN size(words) END")).alias("least"), F.collect_set(F.expr(f"CASE WHEN size(words) < {WINDOW} THEN size(words) END")).alias("short"), F.sum(F.size("words")).alias("total")).first()
    step = min(RUN, shape.least or RUN) - WINDOW + 1
    sent = [_doc_windows(WINDOW, step)] + [_doc_windows(size, 1) for size in sorted(shape.short or [])]

    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text)
    forms = [F.expr(word_array("lower(text)")).alias("raw"), F.expr(word_array(template("text"))).alias("words")]
    last = f"greatest(0, size(words) - {WINDOW})"
    theirs = items.select("item_id", F.expr(f"explode(array_distinct(concat({_item_windows('words', last, LITERALS)}, {_item_windows('inner', '0', LITERALS)}, {_item_windows('raw', last, 0)})))").alias("window"))
    theirs = theirs.select("item_id", F.col("window.at").alias("item_at"), F.col("window.hash").alias("hash"))
    ours = docs.select("doc_id", *forms).select("doc_id", F.expr(f"explode(concat({', '.join(sent)}))").alias("window")).select("doc_id", F.col("window.at").alias("doc_at"), F.col("window.hash").alias("hash"))
    hits = ours.join(_small(theirs, 3 * (shape.total or 0)), "hash").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift"))
    hits = cut(hits.distinct(), "template-hits", few=True)
    ids = hits.select("doc_id").distinct()
    several = ids.count()
    ours = docs.join(_small(ids, several), "doc_id", "left_semi").select("doc_id", *forms).withColumnsRenamed({"raw": "doc_raw", "words": "doc_words"})
    theirs = items.select("item_id", F.col("raw").alias("item_raw"), F.col("words").alias("item_words"), F.col("inner").alias("item_inner"))
    # along the diagonal: k counts the item's words from low, the document's words start with the one opposite
    both = hits.join(_small(theirs, shape.total or 0), "item_id").join(ours, "doc_id").withColumn("low", F.expr("greatest(0, -shift)"))
    both = both.withColumn("high", F.expr("least(size(item_words), size(doc_words) - shift)")).where("high > low")
    opposite = [F.expr(f"slice({c}, shift + low + 1, high - low)").alias(c) for c in ("doc_raw", "doc_words")]
    both = cut(both.select("doc_id", "item_id", "shift", "low", "high", "item_raw", "item_words", "item_inner", *opposite), "template-diagonals")
    same = "item_words[k] = doc_words[k - low] OR item_raw[k] = doc_raw[k - low] OR item_inner[k] = doc_words[k - low]"
    flags = both.withColumn("same", F.expr(f"transform(sequence(low, high - 1), k -> {same})"))
    slots = F.expr(
        f"transform(filter(sequence(low, high - 1), k -> same[k - low] AND ({_slot('item_words[k]')} OR {_slot('doc_words[k - low]')})), "
        f"k -> struct(k AS k, {_value('item_raw[k]')} AS i, {_value('doc_raw[k - low]')} AS d))"
    )
    # of each slot the last one before it that contradicts it; no run holds both
    earlier = "array_max(transform(filter(slots, p -> p.k < s.k AND p.i = s.i AND p.d <> s.d), p -> p.k))"
    clashes = f"filter(transform(CASE WHEN exists(slots, s -> s.i <> s.d) THEN slots ELSE slice(slots, 1, 0) END, s -> struct(s.k AS k, {earlier} AS p)), c -> c.p IS NOT NULL)"
    flags = flags.withColumn("slots", slots).withColumn("clash", F.expr(f"map_from_entries({clashes})"))
    start = "greatest(a.start, CASE WHEN same[k - low] THEN coalesce(try_element_at(clash, k) + 1, low) ELSE k + 1 END)"
    longest = f"aggregate(sequence(low, high - 1), struct(low AS start, struct(0 AS n, -low AS first) AS run), (a, k) -> struct({start} AS start, greatest(a.run, struct(k - {start} + 1 AS n, -{start} AS first)) AS run), a -> a.run)"
    # written before the filter on it, which Catalyst would else put, with all it is made of, into every lambda
    runs = cut(flags.select("doc_id", "item_id", "shift", "low", "high", F.size("item_words").alias("item_size"), "same", "slots", F.expr(longest).alias("run")), "template-runs", few=True)
    discard(hits)
    discard(both)
    runs = runs.withColumn("first", F.expr("-run.first")).withColumn("need", F.expr(f"least({RUN}, item_size)")).where("run.n >= need")
    severed = "(first > low AND get(same, first - 1 - low)) OR (first + run.n < high AND get(same, first + run.n - low))"
    runs = runs.withColumn("run_words", F.expr(f"CASE WHEN {severed} THEN need ELSE run.n END"))
    runs = runs.withColumn("slots", F.expr("filter(slots, s -> s.k >= first AND s.k < first + run_words)"))
    row = F.struct(
        F.col("run_words").cast("long").alias("run_words"), (-(F.col("first") + F.col("shift"))).cast("long").alias("before"), F.expr("cast(item_size AS long)").alias("item_words"),
        F.expr("cast(size(slots) AS long)").alias("n_slots"), F.expr("cast(size(filter(slots, s -> s.i <> s.d)) AS long)").alias("n_changed"),
    )
    best = runs.select("doc_id", "item_id", row.alias("r")).groupBy("doc_id", "item_id").agg(F.max("r").alias("r"))
    return best.select("doc_id", "item_id", (-F.col("r.before")).alias("at"), "r.run_words", "r.item_words", "r.n_slots", "r.n_changed")
