"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line is the set of its lower-cased words. Words are ordered by rarity: occurrences over all texts are counted in a fixed
number of hash buckets, and a word's rank is its bucket's logarithmic class, then its hash - one order for the whole
corpus, from a table whose size does not depend on it. Lines with equal sets are one entry, known by its first place.

Two sets with a Jaccard similarity of at least t share a word among the first n - ceil(t n) + 1 of each (prefix filter; of
the smaller set the first n - ceil(2t / (1 + t) n) + 1 do), their sizes differ by a factor t at most (length filter), the
words left from the first shared one on must suffice (positional filter), and parity sketches cannot differ in more bits than
the sets in words: a bit is the parity of the number of words that fall on it, so the difference of two sketches is the sketch of the
words not shared, however long the lines; lines of many words have sketches of more bits. What passes is verified on whole
sets. A line goes if an earlier line, by id, text hash and place, is similar.

Large groups of variants are not paired out: entries with a heavy word, one in the prefixes of many, go through a first round.
Each is held against the one before it and the first one among such entries with the same least and greatest word hash, or the
same two rarest words; only groups of more than GROUP entries are salted, as salts part near copies. Beside it, each is held
against the most alike of the LEADERS first entries of a quarter of its heavy words and of its last one: most near copies of a
large group find a leader. Entries found similar to an earlier one are settled and are looked up no more; the join finds earlier
lines for all others. Of those, the candidate with the most alike sketch is verified first, the rest only for entries that this
did not settle.

Places are named by 64-bit hashes while pairs are found and verified, words by 56-bit hashes.

Defined results: null texts stay null, lines without words stay; rows with equal id and text are one document and keep the
same lines; a text whose lines all go becomes empty; line ends other than the removed lines' stay as they are; a null id is
an id like any other and comes first; an empty table gives no rows; a long text is split once. Columns of docs named n_lines
or n_removed are replaced by the operator's; all others, whatever their names, stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Tables, aside, back, cut

BUCKETS = 1 << 18
#: Larger groups of the first round are salted, so that at most so many entries or so stand in one, whatever the corpus.
GROUP = 16_384
#: So many first entries of a prefix word are candidates of all others before the join.
LEADERS = 24
#: Words of the prefixes of more than so many entries (or the root of the number of all entries, if that is more, as common
#: words grow with the corpus) have leaders; the pairs of all others are left to the join.
HEAVY = 256
#: Of these, so many with the most alike sketches are verified.
ALIKE = 4
#: Values of a table of fixed size that are gathered at a time.
_CHUNK_BITS = 12
PLACE = ["id", "th", "line_no"]
SKETCH = ["s1", "s2"]
#: Sets of more words than this have sketches of 128 bits.
WIDE = 48
_MASK = (1 << 56) - 1
#: Blanks other than spaces are looked for as bytes: a pattern would turn every text into a Java string first.
_BLANK = " or ".join(f"contains({{0}}, '{c}')" for c in (r"\t", r"\r", r"\u000b", r"\u000c"))
_NORMAL = f"if({_BLANK}, translate(lower({{0}}), '\\t\\r\\u000b\\u000c', '    '), lower({{0}}))"


def _hashes(line: str) -> Column:
    """Distinct hashes of a line's words."""
    words = F.split(F.expr(_NORMAL.format(line)), " ")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())


def _lines(texts: DataFrame) -> DataFrame:
    lines = texts.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("pk", F.xxhash64(*PLACE))


def _dense(found: DataFrame, size: int, value: Column) -> DataFrame:
    """One row with an array of `size` values, from rows (id, c); its size does not depend on the corpus."""
    all_ids = found.sparkSession.range(size).join(found, "id", "left").select("id", value.alias("c"))
    gather = lambda at: F.sort_array(F.collect_list(F.struct(at, "c"))).alias("all")
    parts = all_ids.groupBy(F.shiftright("id", _CHUNK_BITS).alias("part")).agg(gather("id")).select("part", F.col("all.c").alias("c"))
    return parts.agg(gather("part")).select(F.flatten("all.c").alias("c"))


def told_apart(rows: DataFrame, key: str, hashes: DataFrame, tables: Tables, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key, a hash, is marked, and the others: a table of bounded size marks all given hashes and few more, so most
    other rows are not shuffled to be told apart."""
    size = min(1 << 23, 1 << max(16, (16 * hashes.count()).bit_length()))
    found = hashes.select(F.pmod(key, F.lit(size)).alias("id")).distinct().withColumn("m", F.lit(True))
    marks = tables.cut(_dense(found, size, F.coalesce("m", F.lit(False))), name)
    all_ = rows.withColumn("__marks", marks.scalar())
    on = F.expr(f"coalesce(__marks[cast(pmod({key}, {size}L) as int)], false)")
    return all_.where(on).drop("__marks"), all_.where(~on).drop("__marks")


def rarity(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: for each bucket of word hashes the class (0 to 127) of its number of occurrences, as a rank's high bits."""
    words = texts.select(F.explode(F.split(F.expr(f"replace({_NORMAL.format('text')}, '\\n', ' ')"), " ")).alias("w"))
    counts = words.select(F.xxhash64("w").bitwiseAND(F.lit(buckets - 1)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return _dense(counts, buckets, F.shiftleft(F.least(F.lit(127), F.floor(3 * F.log2(F.coalesce("n", F.lit(1))))).cast("long"), 56))


def entries_of(lines: DataFrame, classes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Lines with words, as sets: h and n name the set; s1 and s2 are its sketch, ends names its least and greatest hashes,
    rare its two rarest words, prefix its rarest words."""
    hashed = lines.where(F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "").select(*PLACE, "pk", _hashes("line").alias("hashes"))
    # hashes and classes are read once, and nothing else but names is computed beside them, so the planner folds all into one
    # expression; else the table, 2 MB, were copied into every row (a test looks at the plan). No class is null, which sorts longs.
    sized = hashed.withColumn("classes", classes.scalar())
    word = f"coalesce(classes[x & {buckets - 1}], 0L) | (x & {_MASK}L)"
    ranked = sized.select(*PLACE, "pk", F.expr(f"sort_array(transform(hashes, x -> {word}))").alias("words"))
    # low is read twice, so it is formed once
    ranked = ranked.withColumns({"n": F.size("words"), "low": F.expr(f"transform(words, x -> x & {_MASK}L)")})
    bit = "shiftleft({0}, cast(x & 63 as int))"
    of = lambda one: f"aggregate(words, 0L, (a, x) -> a ^ {bit.format(one)})"
    prefix = "slice(words, 1, n - cast(ceil(0.8D * n - 1e-9D) as int) + 1)"
    return ranked.select(
        *PLACE,
        "pk",
        F.xxhash64("words").alias("h"),
        "n",
        F.expr(of("1L")).alias("s1"),
        F.expr(f"if(n > {WIDE}, {of('shiftright(x, 6) & 1L')}, 0L)").alias("s2"),
        F.xxhash64(F.array_min("low"), F.array_max("low")).alias("ends"),
        F.xxhash64(F.get("words", F.lit(0)), F.get("words", F.lit(1))).alias("rare"),
        F.expr(f"transform({prefix}, x -> cast(x & 2147483647 as int))").alias("prefix"),
    )


def _possible(a: str, b: str, n1: str, n2: str) -> str:
    """Length and sketch filters for a Jaccard similarity of 0.8, the cheapest tests first: sets differ in a ninth of their
    sizes' sum at most.

    s1 has all words on 64 bits, s2 those with the seventh bit of the hash set, so s1 ^ s2 and s2 are 128 bits."""
    x1, x2 = (f"({a}{s} ^ {b}{s})" for s in SKETCH)
    wide = f"{n1} <= {WIDE} or {n2} <= {WIDE} or 9 * (bit_count({x1} ^ {x2}) + bit_count({x2})) <= {n1} + {n2}"
    return f"5 * {n1} >= 4 * {n2} and 5 * {n2} >= 4 * {n1} and 9 * bit_count({x1}) <= {n1} + {n2} and ({wide})"


def _sets(wanted: DataFrame, entries: DataFrame, texts: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Written (pk, s): place and whole set of the wanted entries, whose lines are read again. A table of bounded size marks
    hashes of their documents, so most others are not split into lines."""
    wanted = tables.cut(entries.join(wanted, "pk", "left_semi").select("pk", F.xxhash64("id", "th").alias("doc")), f"{name}-places")
    size = min(1 << 23, 1 << max(16, (16 * wanted.count()).bit_length()))
    marked = wanted.select(F.pmod("doc", F.lit(size)).alias("id")).distinct().withColumn("m", F.lit(True))
    marks = tables.cut(_dense(marked, size, F.coalesce("m", F.lit(False))), f"{name}-marks")
    some = texts.withColumn("marks", marks.scalar()).where(F.expr(f"marks[cast(pmod(xxhash64(id, th), {size}L) as int)]")).drop("marks")
    # repeated rows have equal lines, any of which names the set
    one = _lines(some).join(wanted.select("pk"), "pk", "left_semi").groupBy("pk").agg(F.any_value(F.struct(*PLACE, "line")).alias("l"))
    sets = tables.cut(one.select("pk", "l.*").select("pk", F.struct(*PLACE, _hashes("line").alias("words")).alias("s")), name)
    tables.drop(f"{name}-places", f"{name}-marks")
    return sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pk of the later place of each pair (a, b) of entries that are similar by their whole sets."""
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("pk").alias(s), F.col("s").alias(f"s{s}")), s)
    both = F.size(F.array_intersect("sa.words", "sb.words"))
    enough = 5 * both >= 4 * (F.size("sa.words") + F.size("sb.words") - both)
    first = F.struct(*(F.col(f"sa.{x}") for x in PLACE)) < F.struct(*(F.col(f"sb.{x}") for x in PLACE))
    return pairs.where(enough).select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("pk")).distinct()


def _neighbours(entries: DataFrame, group: int) -> DataFrame:
    """Round one: pairs of an entry with the one before it and the first one in its group; only groups of more than `group`
    entries are salted, so that near copies meet however large the corpus is."""
    found, possible = None, _possible("o.", "", "o.n", "n")
    for key in ("ends", "rare"):
        # as many rows as large groups: at most one for each `group` entries
        large = entries.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group).select(key, F.ceil(F.col("c") / group).alias("salts"))
        w = W.partitionBy(key, "salt").orderBy(*PLACE)
        this = F.struct("pk", "n", *SKETCH)
        rows = entries.select(key, *PLACE, "pk", "h", "n", *SKETCH).join(F.broadcast(large), key, "left")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("h"), F.coalesce("salts", F.lit(1)))).drop("salts", "h")
        rows = rows.select("pk", "n", *SKETCH, F.array(F.lag(this).over(w), F.first(this).over(w)).alias("others"))
        rows = rows.select("pk", "n", *SKETCH, F.explode("others").alias("o")).where(f"o.pk <> pk and {possible}").select(F.col("o.pk").alias("a"), F.col("pk").alias("b"))
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def _posted(entries: DataFrame) -> DataFrame:
    """A row for each prefix word of the entries (which have done: 1 if settled)."""
    return entries.select("pk", "id", "n", *SKETCH, "done", F.posexplode("prefix").alias("pos", "word"))


def _heavy(entries: DataFrame) -> DataFrame:
    """Words of the prefixes of many entries: at most one for each HEAVY postings."""
    most = max(HEAVY, math.isqrt(entries.count()))
    return entries.select(F.explode("prefix").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("word")


def _crowded(entries: DataFrame, heavy: DataFrame) -> DataFrame:
    """Entries with a heavy word; heavies: (pos, word) of these."""
    some = entries.select("pk", F.posexplode("prefix").alias("pos", "word")).join(heavy, "word")
    words = some.groupBy("pk").agg(F.collect_list(F.struct("pos", "word")).alias("heavies"))
    return entries.withColumn("words", F.size("prefix")).drop("prefix").join(words, "pk")


def _paired(a: DataFrame, b: DataFrame, other: str, first: bool) -> DataFrame:
    """Pairs (a, b, sure, apart) of postings that share a word and pass all filters, once for each such word. By their ids a comes first, if they are
    not equal (sure); b is not settled then, else one of the two. first: only words that may be the first one shared, which is
    enough where all prefix words are posted: the shared words then all stand from it on in both sets."""
    a, b = (x.select("word", *(F.col(c).alias(f"{s}_{c}") for c in ("pk", "id", "n", *SKETCH, "done", "pos"))) for s, x in (("a", a), ("b", b)))
    least = "if(a_n - a_pos < b_n - b_pos, a_n - a_pos, b_n - b_pos)"
    small = "if(a_n < b_n, 9 * a_pos <= a_n, if(b_n < a_n, 9 * b_pos <= b_n, 9 * a_pos <= a_n or 9 * b_pos <= b_n))"
    placed = f"9 * {least} >= 4 * (a_n + b_n)" if first else f"9 * ({least} + if(a_pos < b_pos, a_pos, b_pos)) >= 4 * (a_n + b_n) and {small}"
    # the cheapest tests first, and all of them small, as the planner compiles them into one method
    near = F.expr(f"""a_pk {other} b_pk and {_possible("a_", "b_", "a_n", "b_n")}
        and {placed} and coalesce(if(a_id < b_id, b_done = 0, if(b_id < a_id, a_done = 0, null)), a_done + b_done < 2)""")
    pairs = a.join(b, (a.word == b.word) & near)
    sure, turned = F.expr("coalesce(a_id <> b_id, false)"), F.expr("coalesce(b_id < a_id, false)")
    earlier, later = F.when(turned, F.col("b_pk")).otherwise(F.col("a_pk")), F.when(turned, F.col("a_pk")).otherwise(F.col("b_pk"))
    return pairs.select(earlier.alias("a"), later.alias("b"), sure.alias("sure"), F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1"))).alias("apart"))


def _led(crowded: DataFrame, leaders: int) -> DataFrame:
    """Round one, for large groups of near copies: pairs (a, b) of an entry with the most alike of the first entries that share
    one of a quarter of its heavy words, or its last word; no more than `leaders` rows a posting."""
    some = crowded.select("pk", "id", "n", *SKETCH, F.lit(0).alias("done"), "words", F.inline("heavies")).where("word % 4 = 0 or pos = words - 1").drop("words")
    first = some.withColumn("place", F.row_number().over(W.partitionBy("word").orderBy("id", "pk"))).where(F.col("place") <= leaders)
    alike = F.slice(F.sort_array(F.collect_set(F.struct("apart", "a"))), 1, ALIKE)
    return _paired(first, some, "<>", False).distinct().groupBy("b").agg(alike.alias("some")).select(F.inline("some"), "b").select("a", "b")


def _joined(entries: DataFrame, settled: DataFrame | None, tables: Tables) -> DataFrame:
    """Round two: pairs that share a prefix word and pass all filters, but those whose later one is settled."""
    flagged = entries.withColumn("done", F.lit(0))
    if settled is not None:
        some, others = told_apart(entries, "pk", settled, tables, "settled-marks")
        some = some.join(settled.select("pk", F.lit(1).alias("done")), "pk", "left").withColumn("done", F.coalesce("done", F.lit(0)))
        flagged = some.unionByName(others.withColumn("done", F.lit(0)))
    # both sides read the same columns, so one exchange serves both
    posted = _posted(flagged)
    return _paired(posted, posted, "<", True).distinct()


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, group: int = GROUP, leaders: int = LEADERS) -> DataFrame:
    """(id, th, gone): of each document the numbers of the lines that have an earlier similar line."""
    texts, tables = _texts(docs, id, text), Tables(docs.sparkSession)
    classes = tables.cut(rarity(texts, buckets), "rarity")
    lines = tables.cut(entries_of(_lines(texts), classes, buckets), "lines")
    # the first place of each set; each task passes on one row of a set at most, however many lines share it
    place = F.row_number().over(W.partitionBy("h", "n").orderBy(*PLACE))
    entries = tables.cut(lines.withColumn("place", place).where("place = 1").drop("place"), "entries")
    lines = tables.cut(lines.select(*PLACE, "pk", "h", "n"), "places")
    tables.drop("rarity", "lines")
    heavy, settled = tables.cut(_heavy(entries), "heavy"), None
    if not heavy.isEmpty():
        crowded = tables.cut(_crowded(entries, heavy), "crowded")
        near = tables.cut(_neighbours(crowded, group).unionByName(_led(crowded, leaders)).distinct(), "near")
        sets = _sets(near.select(F.explode(F.array("a", "b")).alias("pk")), entries, texts, tables, "near-sets")
        settled = tables.cut(_verified(near, sets), "settled")
        tables.drop("crowded", "near", "near-sets")
    pairs = tables.cut(_joined(entries, settled, tables), "joined")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("pk")), entries, texts, tables, "sets")
    best = pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
    known = tables.cut(_verified(best, sets), "best")
    if settled is not None:
        known = known.unionByName(settled)
    # where the order is not sure, within a document, either place may be the later one: such pairs are all verified
    rest = pairs.where("sure").join(known.select(F.col("pk").alias("b")), "b", "left_anti").unionByName(pairs.where("not sure"))
    later = tables.cut(_verified(rest.select("a", "b"), sets).unionByName(known).distinct(), "similar")
    # lines of an entry beyond its first place go, and first places that are similar to an earlier entry's
    firsts = entries.select("h", "n", "pk").join(later.select("pk", F.lit(True).alias("gone")), "pk", "left").withColumnRenamed("pk", "first")
    gone = lines.join(firsts, ["h", "n"]).where((F.col("pk") != F.col("first")) | F.col("gone"))
    gone = cut(gone.groupBy("id", "th").agg(F.array_distinct(F.collect_list("line_no")).alias("gone")), "gone")
    tables.drop(*tables.paths)
    return gone


def _marked(docs: DataFrame, id: str, text: str, buckets: int, group: int) -> tuple[DataFrame, Column]:
    """docs with __gone (numbers of lines to remove, null if none), and the text without those lines."""
    gone = repeated_lines(docs, id, text, buckets, group).toDF("__id", "__th", "__gone")
    # most texts that keep all lines are not shuffled to be told apart
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.col(text)))
    some, others = told_apart(hashed, "__text_hash", gone.select(F.col("__th").alias("__text_hash")), Tables(docs.sparkSession), "gone-marks")
    some = some.join(gone, (F.col("__text_hash") == F.col("__th")) & F.col(id).eqNullSafe(F.col("__id")), "left").drop("__id", "__th")
    marked = some.unionByName(others, allowMissingColumns=True).drop("__text_hash")
    body = F.col(text).cast("string")
    some = F.filter(F.split(body, "\n", -1), lambda line, at: ~F.array_contains("__gone", at))
    return marked, F.when(F.col("__gone").isNull(), body).otherwise(F.array_join(some, "\n"))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, group: int = GROUP) -> DataFrame:
    """docs with the lines that have an earlier similar line removed from the text, and n_lines and n_removed."""
    marked, new = _marked(docs.drop("n_lines", "n_removed"), id, text, buckets, group)
    body = F.col(text).cast("string")
    n = F.when(body.isNotNull(), F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    columns = [new.alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return marked.select(*columns, n.cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))


def clean(docs: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, group: int = GROUP) -> DataFrame:
    """docs, columns (whatever their names) as they are, without repeated lines; documents that lost lines and of which only
    blanks are left go."""
    own, names = aside(docs)
    marked, new = _marked(own, names[id], names[text], buckets, group)
    left = F.col("__gone").isNull() | new.rlike(r"[^\x20\x09-\x0D]")
    return back(marked.withColumn("__new", new).where(left), names | {text: "__new"})
