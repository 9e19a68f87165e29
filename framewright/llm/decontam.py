"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: numbers, capitalised names inside a sentence and units behind a number turn into typed
placeholders, other words are lower-cased. Windows of ``WORDS`` template words are hashed and joined to the benchmark's windows. Matches of one document and item at one distance between their positions form an alignment; it counts if
each slot value of the item stands for one value of the document throughout. Capitalised words that begin a sentence may be names or not: windows
with such a word are hashed in both readings, and an alignment keeps to one reading. A document holds an
item if the consistent alignments of a reading cover ``SIMILARITY`` of the item's windows or more, whatever numbers, names and units it has.

Windows with fewer than ``LITERALS`` words that are no placeholders say nothing and are left out on both sides. Items of less than ``WORDS`` words or
without a telling window are held where all their words, numbers and names included, stand in a row. The benchmark's windows are
broadcast only if their counted number is ``BROADCAST`` or less; else both sides are shuffled. So are the keys of the texts that met one.

Defined results: null or empty texts hold nothing; a text with fewer words than a window is one window; items with a null
item_id or without words match nothing; repeated documents are judged alike, repeated items are one item, and of several texts of one item_id each counts; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import free_names, written

WORDS, SIMILARITY, LITERALS = 5, 0.8, 3
BROADCAST = 200_000
UNITS = "mm cm m km g kg mg t l ml s min h ms hz khz mhz ghz w kw v a k kb mb gb tb inch inches foot feet yard yards mile miles pound pounds ounce ounces dollar dollars euro euros cent cents percent second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres degree degrees".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve hundred thousand million".split()
_NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;]\s\p{Lu})\p{Ll}+"
#: Other capitalised words: they begin a sentence, or stand behind a quote, a bracket or a line's end.
_FIRST = r"(?<![\p{L}\p{N}\x01])(\p{Lu}\p{Ll}+)"
_BETWEEN = r"(?!(?<=\p{N})[.,](?=\p{N}))[^\p{L}\p{N}\x01\x02]+"


def _numeric(x: Column) -> Column:
    return F.substring(x, 1, 1).between("0", "9") | x.isin(NUMBERS)


def _words() -> Column:
    """A text's words, lower-cased: names marked by \\x01, capitalised words that may be names or not by \\x02."""
    text = F.translate(F.coalesce("text", F.lit("")), "\x01\x02", "  ")
    marked = F.lower(F.regexp_replace(F.regexp_replace(text, f"({_NAME})", "\x01$1"), _FIRST, "\x02$1"))
    return F.filter(F.split(marked, _BETWEEN), lambda x: x != "")


def templates(df: DataFrame) -> DataFrame:
    """``df`` with tmpl and named, the template words in both readings, and value and other, the slots' values (null at other words) in both."""
    words = df.withColumn("marked", _words()).withColumn("raw", F.transform("marked", lambda x: F.when(x.startswith("\x02"), F.substring(x, 2, 2**31 - 1)).otherwise(x)))

    def kind(x, i):
        unit = x.isin(UNITS) & (i > 0) & F.coalesce(_numeric(F.get("raw", i - 1)), F.lit(False))
        return F.when(x.startswith("\x01"), "<name>").when(_numeric(x), "<num>").when(unit, "<unit>").otherwise(x)

    tmpl = words.withColumn("tmpl", F.transform("raw", kind))
    name = lambda i: F.get("marked", i).startswith("\x02")
    named = tmpl.withColumn("named", F.transform("tmpl", lambda x, i: F.when(name(i) & ~x.startswith("<"), "<name>").otherwise(x)))
    value = F.transform("tmpl", lambda x, i: F.when(x.startswith("<"), F.concat(x, F.get("raw", i))))
    other = F.transform("named", lambda x, i: F.when(x.startswith("<"), F.concat(x, F.when(name(i) & (x == "<name>"), "\x01").otherwise(""), F.get("raw", i))))
    return named.select(*df.columns, "tmpl", "named", value.alias("value"), other.alias("other"))


def windows(df: DataFrame, *key: str) -> DataFrame:
    """(key, pos, readings, h) for each window of template words; readings are 1 (first words as they are), 2 (as names) or 3 (no difference)."""
    words = templates(df).select(*key, *[F.transform(t, lambda x: F.xxhash64(x)).alias(t) for t in ("tmpl", "named")])
    n = F.size("tmpl")
    window = lambda i: F.struct(*[F.xxhash64(*[F.get(t, i + j) for j in range(WORDS)]).alias(t) for t in ("tmpl", "named")])
    whole = F.struct(F.xxhash64(F.col("tmpl")).alias("tmpl"), F.xxhash64(F.col("named")).alias("named"))
    each = F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), window)).when(n > 0, F.array(whole))
    # the outer form keeps the optimiser from deriving a filter that would work the windows out a second time
    each = words.select(*key, F.posexplode_outer(each).alias("pos", "w")).where("w.tmpl is not null")
    form = lambda r, t: F.struct(F.lit(r).alias("readings"), F.col("w." + t).alias("h"))
    forms = F.when(F.col("w.tmpl") == F.col("w.named"), F.array(form(3, "tmpl"))).otherwise(F.array(form(1, "tmpl"), form(2, "named")))
    return each.select(*key, "pos", F.explode(forms).alias("f")).select(*key, "pos", "f.*")


def slots(at: DataFrame, df: DataFrame, *key: str, few: bool = False) -> DataFrame:
    """``at`` (key, pos, readings) with width and slots, the slots' values of each window, as an array; ``df`` has key and text.

    With ``few`` the keys of ``at`` are broadcast, and only the texts that have one are shuffled."""
    keys = at.select(*key).distinct()
    texts = templates(df.join(F.broadcast(keys) if few else keys, [*key], "left_semi").select(*key, "text").dropDuplicates([*key]))
    all_of = at.join(texts.select(*key, "tmpl", "value", "other"), [*key])
    part = lambda c: F.slice(c, F.col("pos") + 1, WORDS)
    held = F.filter(F.when(F.col("readings") == 2, part("other")).otherwise(part("value")), lambda x: x.isNotNull())
    return all_of.select(*at.columns, F.least(F.size("tmpl"), F.lit(WORDS)).alias("width"), held.alias("slots"))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, version, text): the different texts of each item_id."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.distinct().select("item_id", F.xxhash64("text").alias("version"), "text")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, version, q, ireadings, h, islots, m1, m2): the telling windows of each item, m1 and m2 of them in the two readings."""
    items = _items(benchmark)
    w = slots(windows(items, "item_id", "version"), items, "item_id", "version").where(F.col("width") - F.size("slots") >= F.least(F.lit(LITERALS), "width"))
    w = w.select("item_id", "version", F.col("pos").alias("q"), F.col("readings").alias("ireadings"), "h", F.col("slots").alias("islots"))
    counts = w.groupBy("item_id", "version").agg(F.count_if(F.col("ireadings") != 2).alias("m1"), F.count_if(F.col("ireadings") != 1).alias("m2"))
    return w.join(counts, ["item_id", "version"])


def _plain(words: Column) -> Column:
    return F.transform(words, lambda x: F.translate(x, "\x01\x02", ""))


def exact(docs: DataFrame, benchmark: DataFrame, telling: DataFrame) -> DataFrame | None:
    """(k1, k2, item_id): texts that hold all words of an item, in a row, for items of less than ``WORDS`` words or without a telling window."""
    items = _items(benchmark).withColumn("w", _plain(_words())).where(F.size("w") > 0)
    known = telling.where("m1 > 0").select("item_id", "version").distinct().withColumn("known", F.lit(True))
    items = items.join(known, ["item_id", "version"], "left").where((F.size("w") < WORDS) | F.col("known").isNull())
    key = F.least(F.size("w"), F.lit(WORDS))
    items = items.select("item_id", F.xxhash64(F.slice("w", F.lit(1), key)).alias("h"), key.alias("k"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("phrase"))
    sizes = {r.k: r["count"] for r in items.groupBy("k").count().collect()}
    if not sizes:
        return None
    if sum(sizes.values()) <= BROADCAST:
        items = F.broadcast(items)
    first = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.slice("w", i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))
    texts = docs.select("k1", "k2", _plain(_words()).alias("w"))
    starts = texts.select("k1", "k2", F.explode(F.array_distinct(F.concat(*[first(k) for k in sorted(sizes)]))).alias("h"))
    met = starts.join(items, "h").select("k1", "k2", "item_id", "phrase").distinct()
    said = docs.select("k1", "k2", F.concat(F.lit(" "), F.array_join(_plain(_words()), " "), F.lit(" ")).alias("said")).dropDuplicates(["k1", "k2"])
    return met.join(said, ["k1", "k2"]).where(F.contains("said", "phrase")).select("k1", "k2", "item_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(k1, k2, item_id, containment): the items that each text, by its key, holds. ``docs`` has k1, k2 and text."""
    telling = items = written(item_windows(benchmark), "items")
    if items.count() <= BROADCAST:
        items = F.broadcast(items)
    met = written(windows(docs.select("k1", "k2", "text"), "k1", "k2").join(items, "h").drop("h"), "met")
    # equal windows have equally many slots, so only those that met an item's window are looked up
    few = met.select("k1", "k2").distinct().count() <= BROADCAST
    met = slots(met, docs, "k1", "k2", few=few).withColumn("pairs", F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d")))
    both = F.col("readings").bitwiseAND(F.col("ireadings"))
    reading = F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda r: both.bitwiseAND(r) > 0))
    met = met.select("k1", "k2", "item_id", "version", "m1", "m2", "q", (F.col("pos") - F.col("q")).alias("shift"), "pairs", reading.alias("reading"))
    met = met.withColumn("m", F.when(F.col("reading") == 1, F.col("m1")).otherwise(F.col("m2"))).drop("m1", "m2")
    lines = met.groupBy("k1", "k2", "item_id", "version", "reading", "m", "shift").agg(F.collect_set("q").alias("qs"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    lines = lines.where(F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == F.size("pairs"))
    found = lines.groupBy("k1", "k2", "item_id", "version", "reading", "m").agg(F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("n"))
    found = found.select("k1", "k2", "item_id", (F.col("n") / F.col("m")).alias("containment")).where(F.col("containment") >= similarity)
    whole = exact(docs, benchmark, telling)
    if whole is not None:
        found = found.unionByName(whole.withColumn("containment", F.lit(1.0)))
    return found.groupBy("k1", "k2", "item_id").agg(F.max("containment").alias("containment"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with items, the sorted item_ids that each document holds (empty if none), and containment, the largest.

    Columns of these names that ``docs`` has already are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("items", "containment")])
    k1, k2 = free_names(docs, "k1", "k2")
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), F.xxhash64(F.coalesce("text", F.lit("")))]
    held = matches(docs.select(key[0].alias("k1"), key[1].alias("k2"), "text"), benchmark, similarity)
    held = held.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("containment").alias("containment"))
    both = docs.withColumns({k1: key[0], k2: key[1]}).join(held, [k1, k2], "left")
    return both.select(*docs.columns, F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
