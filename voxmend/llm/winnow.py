"""Document fingerprints by winnowing, and how alike they are under an edit. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmend.llm.common import only

#: Words of a gram, and grams of a window. Two texts that share a run of GRAM_WORDS + WINDOW_GRAMS - 1 words share a hash.
GRAM_WORDS = 5
WINDOW_GRAMS = 8
#: A selected gram is one number: 32 bits of hash, then 31 bits (all places that an array has) that fall as the gram's position rises.
POSITION_BITS = 31
_LAST = (1 << POSITION_BITS) - 1
#: Documents of a stretch of neighbouring doc_ids, about, and the most stretches. Larger ones are sorted with spilling.
STRETCH_DOCS = 1024
MAX_STRETCHES = 1 << 16
#: Doc_ids, about, that the bounds of stretches are taken from.
BOUND_IDS = 1 << 20


def word_hashes(text: Column) -> Column:
    """The hashes of the words of a text in lower case; words are runs of anything but ASCII white space."""
    return F.transform(F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), ""), lambda w: F.xxhash64(w))


def turned(x: Column, n: int) -> Column:
    """A 64-bit number rotated left."""
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def beside(x: Column, n: int, size: Column) -> Column:
    """An array of size items from its item n on (from 0), to lie beside the same array from its start."""
    return F.slice(x, F.lit(n + 1), F.greatest(size - n, F.lit(0)))


def rolled(hashes: Column, k: int = GRAM_WORDS) -> Column:
    """The cyclic polynomial hash of each k-gram: its words' hashes, each rotated by the number of words behind it, xored.

    It rolls: the next gram's is this one rotated by 1, without the leaving word's hash rotated by k, with the entering
    word's. Catalyst carries no state from item to item without copying the array, so the roll is done for all places at
    once by doubling: grams of 2 words from two neighbours, of 4 from two of those, and so on. A text with fewer than k
    words is one gram of all of them.
    """
    n = F.size(hashes)

    def joined(left: Column, right: Column, places: Column, bits: int) -> Column:
        return F.zip_with(F.slice(left, F.lit(1), places), F.slice(right, F.lit(1), places), lambda a, b: turned(a, bits).bitwiseXOR(b))

    done, width, whole = None, 0, hashes
    size = 1
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            if done is None:
                done, width = whole, size
            else:  # size words, then the width words of done behind them
                done, width = joined(whole, beside(done, size, n - width + 1), F.greatest(n - (width + size) + 1, F.lit(0)), width), width + size
        if bit + 1 < k.bit_length():
            whole, size = joined(whole, beside(whole, size, n - size + 1), F.greatest(n - 2 * size + 1, F.lit(0)), size), 2 * size
    few = F.array(F.aggregate(hashes, F.lit(0).cast("long"), lambda h, w: turned(h, 1).bitwiseXOR(w)))
    return F.when(n >= k, done).when(n > 0, few).otherwise(F.array().cast("array<long>"))


def grams(hashes: Column, k: int = GRAM_WORDS) -> Column:
    """A number for each k-gram of an array of word hashes (a shorter array is one gram, an empty one has none): 32 bits of
    its rolling hash, then its place. On equal hashes the number of the later gram is the smaller one."""
    return F.transform(rolled(hashes, k), lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 1 + POSITION_BITS), POSITION_BITS).bitwiseOR(F.lit(_LAST) - i.cast("long")))


def selected(numbers: Column, w: int = WINDOW_GRAMS) -> Column:
    """The smallest number of every window of w grams (of all, if there are fewer), in order of position. As equal hashes
    rank by position from the right, each window's choice is its rightmost minimum. Minima of windows double as well."""
    n = F.size(numbers)
    least, size = numbers, 1
    while size < w:
        more = min(size, w - size)
        places = F.greatest(n - (size + more) + 1, F.lit(0))
        least, size = F.zip_with(F.slice(least, F.lit(1), places), F.slice(beside(least, more, n - size + 1), F.lit(1), places), lambda a, b: F.least(a, b)), size + more
    return F.when(n >= w, F.array_distinct(least)).when(n > 0, F.array(F.array_min(numbers))).otherwise(F.array().cast("array<long>"))


def shown(picked: Column) -> Column:
    """hash:position of each selected gram, in hexadecimal and decimal, with spaces between."""
    return F.array_join(F.transform(picked, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, POSITION_BITS))), F.lit(":"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"))), " ")


def hashes_of(picked: Column) -> Column:
    return F.array_distinct(F.transform(picked, lambda x: F.shiftright(x, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared hashes over all hashes of both; 1 if both have none."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (see shown) of every row of docs (doc_id, text); one scan, no shuffle. Null or empty text: empty."""
    hashed = only(docs, doc_id="long", text="string").select("doc_id", word_hashes(F.coalesce("text", F.lit(""))).alias("hashes"))
    return hashed.select("doc_id", grams(F.col("hashes")).alias("grams")).select("doc_id", selected(F.col("grams")).alias("picked")).select("doc_id", shown(F.col("picked")).alias("fingerprint"))


def stretch_of(doc_id: Column, bounds: list[int], steps: int) -> Column:
    """How many of the 2**steps - 1 sorted bounds are at most doc_id, by binary search; null doc_id: 0."""
    edges = F.lit(bounds) if bounds else F.array(F.lit(0))
    halves = F.array(*(F.lit(1 << s) for s in reversed(range(steps)))) if steps else F.array().cast("array<int>")
    return F.aggregate(halves, F.lit(0), lambda low, half: F.when(F.get(edges, low + half - 1) <= doc_id, low + half).otherwise(low))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, mark), each row twice or once: stretch, guest, and the text of the next row in descending
    (doc_id, mark), after the last the first. Guests are to be dropped once nothing looks ahead any more.

    Rows are dealt by stretches of doc_id, and the first row of each stretch visits the end of the stretch above it as a
    guest, so that one window within stretches sees every next row: texts are shuffled once. Bounds of stretches are
    quantiles of the doc_ids below a hash bound, BOUND_IDS of them about, however many rows there are.
    """
    keys = docs.select("doc_id")
    rows = keys.count()
    steps = max(0, min(MAX_STRETCHES, -(-rows // STRETCH_DOCS)) - 1).bit_length()
    n = (1 << steps) - 1
    low = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11).cast("double") / float(1 << 53)
    some = keys.where(low < BOUND_IDS / max(rows, 1))
    bounds = some.agg(F.percentile_approx("doc_id", [(i + 1) / (n + 1) for i in range(n)], max(10000, 4 * n))).first()[0] if n else []
    bounds = list(bounds or [0] * n)
    placed = docs.withColumn("stretch", stretch_of(F.col("doc_id"), bounds, steps))
    # One row a stretch (MAX_STRETCHES at most): its first row, and the next stretch above that has rows.
    heads = placed.groupBy("stretch").agg(F.max(F.struct("doc_id", "mark")).alias("head"))
    above = F.lead("stretch").over(Window.orderBy("stretch"))
    heads = heads.select(F.col("stretch").alias("home"), "head", F.coalesce(above, F.first("stretch").over(Window.orderBy("stretch"))).alias("host"))
    met = placed.join(F.broadcast(heads), (F.col("stretch") == F.col("home")) & F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.mark") == F.col("mark")), "left")
    both = F.when(F.col("host").isNotNull(), F.array(F.struct(F.col("stretch").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))))
    both = both.otherwise(F.array(F.struct(F.col("stretch").alias("at"), F.lit(False).alias("guest"))))
    dealt = met.withColumn("place", F.explode(both)).select("doc_id", "text", "mark", F.col("place.at").alias("stretch"), F.col("place.guest").alias("guest"))
    return dealt.withColumn("next_text", F.lead("text").over(following()))


def following() -> Window:
    return Window.partitionBy("stretch").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("mark").desc())


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in descending doc_id, after the last the first. near_edited and near_next compare the fingerprint with the
    edited text's and the next document's (see likeness). Null text counts as empty; an empty text has an empty
    fingerprint. Rows with one doc_id follow each other by a hash of the text, equal rows in any order (they are alike);
    null doc_ids come last. A single row is its own next. An empty table gives no rows; extra columns are ignored.
    """
    kept = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("mark", F.xxhash64("text"))
    seen = with_next(kept)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = seen.select("doc_id", "mark", "stretch", "guest", "text", F.length("text").cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).alias("edited"))
    names = ["doc_id", "mark", "stretch", "guest", "n_chars"]
    hashed = edited.select(*names, F.sha2("edited", 256).alias("edited_sha256"), word_hashes(F.col("text")).alias("a"), word_hashes(F.col("edited")).alias("b"))
    names.append("edited_sha256")
    rolled = hashed.select(*names, grams(F.col("a")).alias("a"), grams(F.col("b")).alias("b"))
    picked = rolled.select(*names, selected(F.col("a")).alias("a"), selected(F.col("b")).alias("b"))
    compared = picked.select("*", hashes_of(F.col("a")).alias("ha"), hashes_of(F.col("b")).alias("hb")).withColumn("hn", F.lead("ha").over(following())).where("not guest")
    return compared.select("doc_id", "n_chars", "edited_sha256", shown(F.col("a")).alias("fingerprint"), shown(F.col("b")).alias("edited_fingerprint"), likeness(F.col("ha"), F.col("hb")).alias("near_edited"), likeness(F.col("ha"), F.col("hn")).alias("near_next"))
