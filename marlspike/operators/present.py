"""What is handed to a reader: projections, wrappers, signatures, tripwires, batches."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.operators.iterate import folded

# How a language writes a comment; others as C does.
COMMENTS = {"python": ("# ", ""), "ruby": ("# ", ""), "yaml": ("# ", ""), "toml": ("# ", ""), "shell": ("# ", ""), "bash": ("# ", ""), "html": ("<!-- ", " -->"), "markdown": ("<!-- ", " -->")}
REDACTED = "[REDACTED]"


#: Characters of the pieces by which names that hold each other meet, and ids that are packed one after another.
GRAM, IDS = 4, 10_000


def compact(results: DataFrame) -> Column:
    """One line for a result: place, type, distinct symbols, score."""
    names = F.array_join(F.array_distinct("symbols"), ", ")
    return F.format_string("%s:%d-%d [%s] %s (%.3f)", "file_path", "start_line", "end_line", "type", names, "score")


def full(results: DataFrame) -> Column:
    """A result with its place and score, type, language and symbols above its content in a fenced block."""
    place = F.format_string("## %s:%d-%d (%.1f%% match)", "file_path", "start_line", "end_line", F.col("score") * 100)
    kind = F.concat(F.lit("Type: "), "type", F.lit(" | Language: "), "language")
    names = F.when(F.size("symbols") > 0, F.concat(F.lit("Symbols: "), F.array_join("symbols", ", ")))
    return F.concat_ws("\n", place, kind, names, F.concat(F.lit("```"), "language"), "content", F.lit("```"))


def tripwire(content: Column, mark: Column, language: Column) -> Column:
    """Content with a mark behind it in a comment of its language."""
    head, tail = F.lit("/* "), F.lit(" */")
    for k, (a, b) in COMMENTS.items():
        head, tail = F.when(language == k, a).otherwise(head), F.when(language == k, b).otherwise(tail)
    return F.concat(content, F.lit("\n"), head, mark, tail)


def strip_token(content: Column, token: str) -> Column:
    return F.replace(content, F.lit(token), F.lit(REDACTED)) if token else content


def derived_key(secret: str, salt: str, info: str) -> bytes:
    """32 bytes by HKDF with SHA-256 (RFC 5869), on the driver: a key is one value."""
    prk = hmac.new(salt.encode(), secret.encode(), hashlib.sha256).digest()
    return hmac.new(prk, info.encode() + b"\x01", hashlib.sha256).digest()


def signature(key: bytes, *parts: Column, size: int = 16) -> Column:
    """HMAC-SHA256 of parts with a zero byte between them, as hexadecimal digits; two hashes on the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = parts[0].cast("binary")
    for p in parts[1:]:
        message = F.concat(message, F.lit(b"\0"), p.cast("binary"))
    digest = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.substring(F.sha2(F.concat(outer, digest), 256), 1, size)


def verified(given: Column, key: bytes, *parts: Column) -> Column:
    """Whether a signature belongs to its parts; both are hashed once more, so how far they agree does not show in the time."""
    return F.sha2(F.coalesce(given, F.lit("")), 256) == F.sha2(signature(key, *parts), 256)


def wrapped(content: Column, label: Column, trust: Column, place: Column, total: Column, nonce: Column, warning: Column, key: bytes | None = None) -> Column:
    """A result between lines that carry a nonce, and a signature where there is a key."""
    sign = F.concat(F.lit("|hmac:"), signature(key, nonce, content)) if key else F.lit("")
    head = F.concat(F.lit("--- RESULT "), place.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), label, F.lit(", trust: "), trust, F.lit(") [nonce:"), nonce, sign, F.lit("] ---"))
    return F.concat_ws("\n", head, warning, content, F.concat(F.lit("--- END RESULT [nonce:"), nonce, F.lit("] ---")))


def encrypted(value: Column, key: Column) -> Column:
    """AES in GCM mode, as base 64; each call draws its own initialisation vector."""
    return F.base64(F.aes_encrypt(value.cast("binary"), key, F.lit("GCM")))


def decrypted(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")


def _shorter(texts: Column) -> Column:
    """Each of some texts, and each with one character left out."""
    cut_ = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    return F.array_distinct(F.concat(texts, F.flatten(F.transform(texts, cut_))))


def _grams(text: Column, size: int = GRAM) -> Column:
    """All pieces of ``size`` characters of a text, and all shorter ones."""

    def pieces(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*map(pieces, range(1, size + 1)))))


def _holding(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """``o, i``: texts of ``outer(o)`` that hold a text of ``inner(i)``, met by the piece of the inner text that the fewest outer ones have."""
    of = outer.select("o", F.explode(_grams(F.col("o"))).alias("piece"))
    counts = of.groupBy("piece").agg(F.count("*").alias("n"))
    whole = F.length("i") <= GRAM
    own = inner.select("i", F.explode(F.when(whole, F.array("i")).otherwise(F.filter(_grams(F.col("i")), lambda p: F.length(p) == GRAM))).alias("piece"))
    rarest = own.join(counts, "piece").groupBy("i").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))  # a piece that no outer text has rules it out, if it is the least
    return of.join(rarest, "piece").filter(F.contains("o", "i")).select("o", "i")


def similar_names(unknown: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """``name, place, suggestion``: known names that hold, are held by, or are within two edits of an unknown one; the nearest first.

    Names within two edits share what is left of them when two characters at most
    are left out of each, and a name that holds another has its rarest piece of
    ``GRAM`` characters: both meet by equality, and only then are compared.
    Null and empty names have and are no suggestions.
    """
    lower = lambda d, n, low: d.select(F.col("name").alias(n)).filter(F.length("name") > 0).distinct().withColumn(low, F.lower(n))
    a, b = lower(unknown, "name", "a"), lower(known, "suggestion", "b")
    left = a.select("a").distinct()
    right = b.select("b").distinct()
    variants = lambda d, c: d.select(c, F.explode(_shorter(_shorter(F.array(c)))).alias("v")).select(c, F.xxhash64("v").alias("v"))
    near = variants(left, "a").join(variants(right, "b"), "v").select("a", "b").distinct().filter(F.levenshtein("a", "b") <= 2)
    held = _holding(left.select(F.col("a").alias("o")), right.select(F.col("b").alias("i"))).select(F.col("o").alias("a"), F.col("i").alias("b"))
    holds = _holding(right.select(F.col("b").alias("o")), left.select(F.col("a").alias("i"))).select(F.col("i").alias("a"), F.col("o").alias("b"))
    met = near.unionByName(held).unionByName(holds).distinct()
    d = met.join(a, "a").join(b, "b").withColumn("d", F.levenshtein("a", "b"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("d", "suggestion"))
    return d.withColumn("place", k).filter(F.col("place") <= least).select("name", "place", "suggestion")


def batches(chunks: DataFrame, most: int = 50, tokens: int = 7500) -> DataFrame:
    """``id, batch`` of ``chunks(id, tokens)``: rows packed in order of id into batches of bounded number and tokens.

    Batches serve calls to a service. Ids pack in blocks of ``IDS``, each on its
    own, so batches have the same numbers in every run.
    """
    def step(state: dict, row: tuple) -> tuple:
        block, i, size = row
        if "n" not in state or state["n"] == most or state["tokens"] + size > tokens:
            state["batch"], state["n"], state["tokens"] = state.get("batch", block * IDS - 1) + 1, 0, 0
        state["n"] += 1
        state["tokens"] += size
        return i, state["batch"]

    d = chunks.select(F.floor(F.col("id") / IDS).alias("block"), "id", "tokens")
    return folded(d, ["block"], ["id"], step, "id bigint, batch bigint")


def invalid(entries: DataFrame, validators: dict[str, Column]) -> DataFrame:
    """``key, error`` of entries that a validator, a column expression by key pattern, does not accept."""
    found = F.filter(F.array(*(F.when(F.col("key").like(k) & ~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in validators.items())), lambda x: x.isNotNull())
    return entries.select("key", F.explode(found).alias("error"))


def tagged(entries: DataFrame, tags: list[str]) -> DataFrame:
    """Entries that bear all tags."""
    return entries.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
