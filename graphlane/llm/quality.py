"""Quality rules: words and symbols of a document, and lines that many documents of a host share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"  # fixed value: what ends a word
SYMBOLS = "#*$%&|<>"  # fixed value
LINE_DOCS = 50  # a line of more distinct documents of one host is removed
LEFT_SHARE = 0.3  # a document that keeps a smaller share of its words is depleted
SALTS = 16


RATING = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]


def rated(docs: DataFrame, line_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per document: doc_id and the columns RATING of cleaned()."""
    return cleaned(docs, line_docs, left_share).select("doc_id", *RATING)


def cleaned(docs: DataFrame, line_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """docs with the lines above the limit removed from text, and the columns n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept, which are of the text as it was.

    docs needs text and source (the host). Null texts count as empty and stay null, a null host is a host. Lines are
    normalised (lower case, digits as 0, runs of spaces as one) and hashed; of each host the distinct documents of a
    line are counted, a document with itself counting once. Lines of more than line_docs documents are removed; a
    document that keeps less than left_share of its words, or fails the base rule, isn't kept. What stays of a text is
    as it was, blank lines too; n_chars, if there, follows a text that lost lines. Other columns and repeated rows
    stay, repeated rows count as documents of their own; columns of RATING's names are replaced. Built-in functions
    only: counts are summed before they are dealt out, and the lines of a host are dealt out by line and salt. The
    text goes with its document's first line only.
    """
    docs = docs.drop(*RATING)
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in own.items()), text.alias("text"), F.coalesce("source", F.lit("")).alias("host"))
    df = df.select(
        *own.values(), "host", "text", F.monotonically_increasing_id().alias("row_no"),
        F.array_remove(F.split("text", f"[{SPACES}]+"), "").alias("words"),
        F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda x: F.translate(x["line"], SPACES, "") != "").alias("lines"),
    )
    df = df.select(
        *own.values(), "host", "row_no", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(line_hash(x["line"]).alias("h"), F.size(F.array_remove(F.split(x["line"], f"[{SPACES}]+"), "")).alias("w"), x["at"].alias("at"))).alias("lines"),
    )
    lines = docs.select(
        F.coalesce("source", F.lit("")).alias("host"),
        F.explode(F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != ""), line_hash))).alias("h"),
    )
    often = lines.groupBy("host", "h").count().where(F.col("count") > line_docs).select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("often"))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    each = df.select("*", F.posexplode_outer("lines").alias("pos", "line")).drop("lines")
    each = each.withColumn(own["text"], F.when(first, F.col(own["text"]))).select("*", F.col("line.h").alias("h"), F.col("line.w").alias("w"), F.col("line.at").alias("at"), F.pmod(F.hash("row_no"), F.lit(SALTS)).alias("salt"))
    base = [*(o for c, o in own.items() if c != "text"), *RATING[:5]]
    found = each.join(often, ["host", "h", "salt"], "left").groupBy("row_no").agg(
        *(F.first(c).alias(c) for c in base), F.first(own["text"], ignorenulls=True).alias(own["text"]),
        F.coalesce(F.sum(F.when(F.col("often"), F.col("w"))), F.lit(0)).cast("long").alias("n_removed_words"),
        F.collect_list(F.when(F.col("often"), F.col("at"))).alias("gone"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("n_removed_words") >= left_share * F.col("n_words"))
    new = {own["text"]: F.when(F.size("gone") > 0, without_lines(F.col(own["text"]), F.col("gone"))).otherwise(F.col(own["text"]))}
    if "n_chars" in own:
        n = own["n_chars"]
        new[n] = F.when(F.size("gone") > 0, F.length(new[own["text"]]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n))
    rating = {"base_failed": failed, "kept": kept}
    return found.select(*(new.get(o, F.col(o)).alias(c) for c, o in own.items()), *(rating.get(c, F.col(c)).alias(c) for c in RATING))


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines at the places `gone`; an array of one element binds the split lines once."""

    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n", -1)), left), 0)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), f"[{SPACES}]+", " ")))


def window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    The windows' hashes, their low bits replaced by the position, are sorted as numbers. Only windows whose upper bits a
    neighbour shares can occur twice; of these, neighbours are compared word by word. Where unequal windows share upper
    bits, equal ones needn't be neighbours: then all windows of the text are sorted by their words instead.
    """
    n = F.size(words)
    mask = F.expr("shiftleft(1L, length(bin(size(words)))) - 1")
    word = lambda i, k: F.get(words, i + k)
    every = lambda make, kind: F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), make)).otherwise(F.array().cast(f"array<{kind}>"))
    bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  f of a value that is computed once

    def hashed(mask: Column) -> Column:
        keys = F.sort_array(every(lambda i: window_hash(*(word(i, k) for k in range(3))).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")), "long"))
        upper = lambda x: x.bitwiseAND(F.bitwise_not(mask))
        beside = lambda k: F.filter(k, lambda x, i: F.coalesce(upper(x) == upper(F.get(k, i - 1)), F.lit(False)) | F.coalesce(upper(x) == upper(F.get(k, i + 1)), F.lit(False)))

        def among(keys: Column) -> Column:
            at = lambda x: x.bitwiseAND(mask).cast("int")
            alike = lambda x, y: F.coalesce(upper(x) == upper(y), F.lit(False))
            same = lambda x, y: alike(x, y) & reduce(Column.__and__, (word(at(x), k) == word(at(y), k) for k in range(3)))
            mixed = F.size(F.filter(keys, lambda x, i: alike(x, F.get(keys, i + 1)) & ~F.coalesce(same(x, F.get(keys, i + 1)), F.lit(False)))) > 0
            own = F.filter(keys, lambda x, i: F.coalesce(same(x, F.get(keys, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(keys, i + 1)), F.lit(False)))
            return F.when(mixed, by_words()).otherwise(F.sort_array(F.transform(own, lambda x: x.bitwiseAND(mask))))

        return bound(keys, lambda k: bound(beside(k), among))

    def by_words() -> Column:
        rows = F.sort_array(every(lambda i: F.struct(*(word(i, k).alias(f"w{k}") for k in range(3)), i.cast("long").alias("at")), "struct<w0:string,w1:string,w2:string,at:bigint>"))
        same = lambda x, y: F.coalesce(reduce(Column.__and__, (x[f"w{k}"] == y[f"w{k}"] for k in range(3))), F.lit(False))
        repeated = lambda r: F.transform(F.filter(r, lambda x, i: same(x, F.get(r, i - 1)) | same(x, F.get(r, i + 1))), lambda x: x["at"])
        return F.sort_array(bound(rows, repeated))

    zero = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"))
    return F.aggregate(bound(mask, hashed), zero, step, lambda a: a["n"])


def good(docs: DataFrame) -> DataFrame:
    """The documents of docs that are kept, without the lines above the limit, with the columns of docs."""
    aside = {c: f"own_{c}" for c in docs.columns if c in RATING}
    rows = cleaned(docs.withColumnsRenamed(aside)).where("kept")
    return rows.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
