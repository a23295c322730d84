"""Content identity: canonical encoding, page ids, keyed ids, sealing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAX_PAGE_BYTES, MIN_PAGE_BYTES


def canonical(*columns: Column) -> Column:
    """Fields joined by ``|``: nulls as ``\\N``, with ``\\`` and ``|`` escaped, so that different rows differ."""
    def one(c: Column) -> Column:
        text = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
        return F.coalesce(text, F.lit("\\N"))

    return F.concat_ws("|", *[one(c) for c in columns])


def page_id(content: Column) -> Column:
    """64 hexadecimal digits, the same for the same content."""
    return F.sha2(content, 256)


def keyed_page_id(content: Column, key: str) -> Column:
    """HMAC of the content by nested digests: equal contents differ between keys."""
    inner = F.sha2(F.concat(F.lit(f"{key}|in|"), content), 256)
    return F.sha2(F.concat(F.lit(f"{key}|out|"), inner), 256)


def short_id(pid: Column) -> Column:
    return F.substring(pid, 1, 12)


def shard(pid: Column) -> Column:
    """Two levels of folders for a page."""
    return F.concat_ws("/", F.substring(pid, 1, 2), F.substring(pid, 3, 2), pid)


def object_key(pool: Column, kind: str, pid: Column) -> Column:
    """Where a tier keeps an object; the pool always comes first."""
    return F.concat_ws("/", pool, F.lit(kind), shard(pid) if kind == "pages" else pid)


def segment_key(pool: Column, segment: Column) -> Column:
    return F.concat(pool, F.lit("/wal/"), F.lpad(segment.cast("string"), 12, "0"), F.lit(".wal"))


def is_id(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def valid_page_size(size: Column) -> Column:
    return (F.bit_count(size) == 1) & size.between(MIN_PAGE_BYTES, MAX_PAGE_BYTES)


def data_key(pool_key: str, database: Column) -> Column:
    """A database's key from its pool's, as 32 bytes; never put it into a result."""
    return F.unhex(F.sha2(F.concat(F.lit(f"data-key|{pool_key}|"), database), 256))


def nonce(key: Column, pid: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.hex(key), F.lit("|nonce|"), pid), 256)), 1, 12)


def seal(content: Column, key: Column, pid: Column, context: Column) -> Column:
    """AES-GCM with a nonce from key and page id: the same page seals to the same bytes, bound to its id and context."""
    return F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), nonce(key, pid), F.concat(context, F.lit("|"), pid))


def unseal(sealed: Column, key: Column, pid: Column, context: Column) -> Column:
    """The content again; null if the tag, the context or the content's id does not fit."""
    plain = F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(context, F.lit("|"), pid))
    return F.when(F.sha2(plain, 256) == pid, plain)
