"""Document fingerprints by winnowing, in DataFrame functions only.

A text's k-grams are k consecutive words. Words are stretches between white space; a character of a script
that is written without blanks (Han, Kana, Thai, Lao, Khmer, Burmese) is a word of its own. Each gram's hash
gets its position in the low bits, inverted, so that the least value of a window is its least hash and, among
equal hashes, the rightmost. A window is `window` consecutive grams, and the fingerprint is the set of the
windows' minima with their positions; a text with fewer grams is one window. The same rule holds for texts of
all lengths, so any two fingerprints compare. Any passage of k + window - 1 words that two texts share gives
them a gram in common.

Whole arrays are handled by JVM expressions; nothing is exploded or shuffled for a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._order import block_of

#: Low bits of an entry: the inverted position of its gram, modulo 2^24; above them 39 bits of hash.
PLACE_BITS = 24
_PLACES = (1 << PLACE_BITS) - 1
_HASHES = (1 << 39) - 1


#: Fixed value: the scripts whose words have no blanks between them.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def words(text: Column) -> Column:
    """Words between spaces, tabs, line feeds and carriage returns; characters of unspaced scripts one by one."""
    for blank in ("\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(blank), F.lit(" "))
    # texts of one byte a character, most of them, hold none of these
    wide = F.octet_length(text) > F.char_length(text)
    text = F.when(wide, F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return F.array_remove(F.split(text, " "), "")


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = 3, window: int = 4) -> DataFrame:
    """df with the column `out`: array<bigint>, the chosen entries in order of position.

    hash_of and place_of take entries apart. A null text has the empty fingerprint of the empty text; a
    text of fewer than k words has one gram, all its words. Texts with equal words have equal fingerprints.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    h, g, m = f"_{out}_words", f"_{out}_grams", f"_{out}_least"
    df = df.withColumn(h, F.transform(words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.xxhash64(w)))
    follow = [lambda i, j=j: F.get(F.col(h), i + j) for j in range(1, k)]
    gram = lambda x, i: F.shiftleft(F.xxhash64(x, *[f(i) for f in follow]).bitwiseAND(F.lit(_HASHES)), PLACE_BITS).bitwiseOR(
        F.lit(_PLACES).cast("bigint") - i.bitwiseAND(F.lit(_PLACES))
    )
    first = F.slice(F.col(h), F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(1)))
    df = df.withColumn(g, F.transform(first, gram))
    step, last = 1, g
    while step < window:
        now = f"{m}{step}"
        df = df.withColumn(now, F.transform(F.col(last), _with_later(last, step)))
        step, last = 2 * step, now
    chosen = F.array_distinct(F.slice(F.col(last), F.lit(1), F.greatest(F.size(g) - (window - 1), F.lit(1))))
    return df.withColumn(out, chosen).drop(h, g, *[f"{m}{1 << i}" for i in range(window.bit_length() - 1)])


def _with_later(column: str, step: int):
    return lambda x, i: F.least(x, F.get(F.col(column), i + step))


def hash_of(entry: Column) -> Column:
    return F.shiftright(entry, PLACE_BITS)


def place_of(entry: Column) -> Column:
    """Position of the gram's first word, modulo 2^24."""
    return F.lit(_PLACES).cast("bigint") - entry.bitwiseAND(F.lit(_PLACES))


def hashes_of(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two sets of hashes, 0 to 1; of two empty ones, 1."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def digest(entries: Column) -> Column:
    """A fingerprint as one string: SHA-256 of its entries."""
    return F.sha2(F.array_join(F.transform(entries, lambda x: F.hex(x)), ".").cast("binary"), 256)


def with_next(df: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(id, text, next): each row with the text of the next id, the first one's after the last.

    Texts are shuffled once. Rows are dealt into ranges of ids; the first row of each range also goes, as a
    marker that is dropped again, to the end of the range before, so no window spans all rows. Rows of equal
    ids follow each other by text; a null id comes first; null texts are empty; a lone row follows itself.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # null sorts before all ids
    rows = rows.withColumn("key", F.coalesce("id", F.lit(-(2**63)).cast("bigint")))
    block = block_of(rows, "key", blocks)
    rows = rows.withColumn("block", block)
    heads = [tuple(x) for x in rows.groupBy("block").agg(F.min("key").alias("key")).orderBy("block").collect()]
    if not heads:
        return rows.select("id", "text", F.col("text").alias("next"))
    # as many as there are blocks
    before = df.sparkSession.createDataFrame([(key, heads[i - 1][0]) for i, (_, key) in enumerate(heads)], "key bigint, block int")
    marks = rows.drop("block").join(F.broadcast(before), "key").groupBy("key", "block").agg(F.min("text").alias("text"))
    marks = marks.select(F.lit(None).cast("bigint").alias("id"), "text", "key", "block", F.lit(True).alias("mark"))
    dealt = rows.select("id", "text", "key", "block", F.lit(False).alias("mark")).unionByName(marks)
    follow = Window.partitionBy("block").orderBy("mark", "key", "text")
    return dealt.withColumn("next", F.lead("text").over(follow)).where(~F.col("mark")).select("id", "text", "next")


def edited_fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, window: int = 2
) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they are.

    The edit replaces the last floor(n/2) code points of a text of n by the first as many (or all) of the
    next text in order of ids. Columns: id, n_chars, edited, fingerprint, edited_fingerprint (entries),
    near_edited, near_next. Defined cases: those of with_next and with_fingerprint; an empty table gives an
    empty table; repeated rows give rows of their own.
    """
    spark = df.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(df, id_col, text_col, blocks).withColumn("n", F.char_length("text"))
    tail = F.expr("n div 2").cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - tail), F.substring("next", F.lit(1), tail)))
    for source, out in (("text", "a"), ("edited", "b"), ("next", "c")):
        rows = with_fingerprint(rows, source, out, k, window).withColumn(f"{out}_hashes", hashes_of(F.col(out)))
    rows = rows.withColumn("near_edited", likeness(F.col("a_hashes"), F.col("b_hashes")))
    rows = rows.withColumn("near_next", likeness(F.col("a_hashes"), F.col("c_hashes")))
    return rows.select(
        "id",
        F.col("n").cast("bigint").alias("n_chars"),
        "edited",
        F.col("a").alias("fingerprint"),
        F.col("b").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
