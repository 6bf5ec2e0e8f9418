"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question with other numbers or names in it has the
same template. Benchmark items give every window of ``width`` template words, documents every ``stride``-th one, by
default every one too; a shared run of width + stride - 1 words (so of ``width``) therefore always shares a window,
wherever it starts. A window of placeholders alone is told apart by its values, so that tables of numbers don't meet at every place; verbatim ones still do.
Items too short for a window are looked for whole, at every place. Windows meet in a hash join; each hit is an alignment of item and
document, which is then compared word by word. Placeholders must be a function from the item's values to the
document's (the same name stands for the same name): within a run of equal words, and among the words that count as
matched. What lies outside, or two values that become equal, never rejects a pair. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import materialise, small

#: Units that may follow a number.
UNITS = "km|m|cm|mm|mi|ft|in|kg|g|mg|lb|lbs|oz|l|ml|h|hr|hrs|hours|hour|min|mins|minutes|s|sec|seconds|days|day|weeks|months|years|usd|eur|dollars|euros|cents|percent|mph|kmh"
#: Benchmark windows that are broadcast at most; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def full_template(text: Column) -> Column:
    """Lower-case words in which a placeholder carries its value: ``‹n:42›``, ``‹u:km›``, ``‹p:anna›``."""
    text = F.replace(F.replace(text, F.lit("‹"), F.lit(" ")), F.lit("›"), F.lit(" "))
    text = F.regexp_replace(text, r"[0-9]+(?:[.,:/][0-9]+)*", "‹n:$0›")
    text = F.regexp_replace(text, rf"(‹n:[^›]*›[ ]?)((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", "$1‹u:$2›")
    text = F.regexp_replace(text, r"\p{Lu}(?<=[\p{L}\p{N},;›] \p{Lu})[\p{L}'’-]*", "‹p:$0›")
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}‹›:.,/\x20\x09-\x0D]+|[.,:/](?![0-9a-z\p{L}])", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def template(full: Column) -> Column:
    """Placeholders without their values."""
    return F.regexp_replace(full, r"‹([npu]):[^›]*›", "‹$1›")


def window_hash(words: Column, full: Column) -> Column:
    """Of template words, or of the words with their values where all are placeholders; ``full`` may be null where that can't be."""
    return F.when(full.isNotNull() & F.forall(words, lambda w: w.startswith("‹")), F.xxhash64(full)).otherwise(F.xxhash64(words))


def windows(words: Column, full: Column, width: int, stride: int) -> Column:
    """(at, hash) of every ``stride``-th run of ``width`` words; none where there are fewer words."""
    last = F.size(words) - width
    cut = lambda i: window_hash(F.slice(words, i + 1, width), F.slice(full, i + 1, width))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.struct(i.alias("at"), cut(i).alias("hash"))))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 8, stride: int = 1, min_run: int = 13, min_share: float = 0.5, min_item: int = 3,
) -> DataFrame:
    """(id, item_id, matched, item_words, run, n_slots), one row per contaminated document and item.

    An alignment counts if it has ``min_run`` equal template words in a row whose placeholders are consistent, or
    covers ``min_share`` of the item. Consistent is what gives one item value one document value; of several, ``matched``
    counts the words of the one that an item value has most often. The best alignment of a pair is returned (most
    matched words, then longest run). n_slots counts the pairs of values over the whole alignment. Null or empty texts and items match nothing, nor do items of under ``min_item`` words; rows with a null id or a null item_id are left out; repeated
    rows give one row a pair. Other columns are ignored.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), full_template(F.col(item_text_col)).alias("full"))
    items = materialise(items.select("item_id", split_words("full").alias("i_full"), split_words(template(F.col("full"))).alias("i_words")).where(F.size("i_words") >= max(min_item, 1)).distinct(), "items")
    marks = items.select("item_id", F.size("i_words").alias("n"), "i_words", "i_full")
    long_marks = marks.where(f"n >= {width + stride - 1}").select("item_id", F.lit(width).alias("w"), F.explode(windows(F.col("i_words"), F.col("i_full"), width, 1)).alias("x"))
    whole = marks.where(f"n < {width + stride - 1}").select("item_id", F.col("n").alias("w"), F.struct(F.lit(0).alias("at"), window_hash(F.col("i_words"), F.col("i_full")).alias("hash")).alias("x"))
    marks = materialise(long_marks.unionByName(whole).select("item_id", "w", F.col("x.at").alias("i_at"), F.col("x.hash").alias("hash")), "marks")
    sizes = [r[0] for r in marks.where(f"w < {width + stride - 1}").select("w").distinct().collect()]  # fewer than width + stride
    few = marks.count() <= BROADCAST_WINDOWS

    named = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # words with their values are cut only where as many placeholders as a window has words follow each other; a generator keeps arrays from being made anew for each window
    bare = r"(?:^|[\x20\x09-\x0D])(?:‹[^\x20\x09-\x0D]*(?:[\x20\x09-\x0D]+|$)){%d}" % min([width, *sizes])
    cut = named.select("id", full_template(F.col("text")).alias("full")).select("id", "full", template(F.col("full")).alias("template"))
    arrays = F.struct(split_words("template").alias("words"), F.when(F.col("template").rlike(bare), split_words("full")).alias("full"))
    cut = cut.select("id", F.inline(F.transform(F.array(arrays), lambda x: x)))

    def sized(w: int) -> Column:
        found = F.coalesce(windows(F.col("words"), F.col("full"), w, stride if w == width else 1), F.array().cast("array<struct<at:int,hash:bigint>>"))
        return F.transform(found, lambda x: F.struct(F.lit(w).alias("w"), x["at"].alias("at"), x["hash"].alias("hash")))

    parts = [sized(w) for w in sorted({width, *sizes})]
    seen = cut.select("id", F.inline(F.concat(*parts) if len(parts) > 1 else parts[0]))
    hits = seen.join(F.broadcast(marks) if few else marks, ["w", "hash"])
    lines = materialise(hits.select("id", "item_id", (F.col("at") - F.col("i_at")).alias("shift")).distinct(), "alignments")

    wanted = materialise(lines.select("id").distinct(), "wanted")
    texts = named.join(small(wanted), "id", "left_semi").withColumn("full", full_template(F.col("text")))
    texts = texts.select("id", split_words("full").alias("d_full"), split_words(template(F.col("full"))).alias("d_words")).distinct()
    pairs = lines.join(texts, "id").join(F.broadcast(items) if few else items, "item_id")
    same = F.expr("transform(i_words, (w, k) -> k + shift >= 0 and k + shift < size(d_words) and coalesce(w = get(d_words, k + shift), false))")
    slots = F.expr("filter(transform(i_full, (v, k) -> if(get(same, k) and v like '%‹%', struct(k as k, v as i, get(d_full, k + shift) as d), null)), x -> x is not null)")
    pairs = pairs.withColumn("same", same).withColumn("slots", slots)
    # slots by item value and place; of each, the last place before with the same item value and another document value, or -1: that of the one before, or what that one has. Each
    # array is read once, as what an aggregate goes over: inside a lambda it would be made anew for every element
    start = "named_struct('i', cast(null as string), 'd', cast(null as string), 'k', -1, 'b', -1, 'out', cast(array() as array<struct<k:int,b:int>>))"
    last = "if(s.i <=> x.i, if(s.d <=> x.d, s.b, s.k), -1)"
    by_value = "array_sort(transform(slots, x -> struct(x.i as i, x.k as k, x.d as d)))"
    prior = f"aggregate({by_value}, {start}, (s, x) -> named_struct('i', x.i, 'd', x.d, 'k', x.k, 'b', {last}, 'out', concat(s.out, array(named_struct('k', x.k, 'b', {last})))), s -> s.out)"
    # a word that doesn't match can't be in a run; one without a value can be in any
    others = "filter(transform(same, (w, k) -> named_struct('k', k, 'b', if(not w, k, if(get(i_full, k) like '%‹%', -2, -1)))), x -> x.b > -2)"
    far = "greatest(s.start, x.b + 1)"
    run = F.expr(f"aggregate(array_sort(concat({others}, {prior})), named_struct('start', 0, 'best', 0), (s, x) -> named_struct('start', {far}, 'best', greatest(s.best, x.k + 1 - {far})), s -> s.best)")
    # of each item value, the words that have its most frequent document value: runs of equal values, in order
    none = "named_struct('i', cast(null as string), 'd', cast(null as string), 'n', 0, 'best', 0, 'sum', 0)"
    count = "if(s.i <=> x.i and s.d <=> x.d, s.n + 1, 1)"
    step = f"named_struct('i', x.i, 'd', x.d, 'n', {count}, 'best', if(s.i <=> x.i, greatest(s.best, {count}), 1), 'sum', if(s.i <=> x.i, s.sum, s.sum + s.best))"
    agreeing = F.expr(f"aggregate(array_sort(transform(slots, x -> struct(x.i as i, x.d as d))), {none}, (s, x) -> {step}, s -> s.sum + s.best) - size(slots)")
    matched = F.size(F.filter("same", lambda x: x)) + agreeing
    pairs = pairs.select("id", "item_id", matched.alias("matched"), F.size("i_words").alias("item_words"), run.alias("run"), F.size(F.expr("array_distinct(transform(slots, y -> struct(y.i, y.d)))")).alias("n_slots"))
    pairs = pairs.where((F.col("run") >= min_run) | (F.col("matched") >= min_share * F.col("item_words")))
    best = pairs.groupBy("id", "item_id").agg(F.max(F.struct("matched", "run", "item_words", "n_slots")).alias("b"))
    return best.select("id", "item_id", "b.matched", "b.item_words", "b.run", "b.n_slots")
