"""Content addresses, stable ids and the byte encodings they are taken over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 URL namespace.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def blob_path(digest: Column) -> Column:
    return F.concat_ws("/", F.substring(digest, 1, 2), digest)


def bucket_of(key: Column, digits: int = 1) -> Column:
    """Bucket from the leading hex digits of the key's hash."""
    return F.conv(F.substring(content_hash(key), 1, digits), 16, 10).cast("int")


def prefixed_id(seed: Column) -> Column:
    return F.concat(F.lit("gid_"), F.substring(content_hash(seed), 1, 16))


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of a name, from SHA-1 without leaving the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def json_text(value: Column) -> Column:
    """A JSON string literal with every non-ASCII character escaped."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        plain = F.replace(plain, F.lit(char), F.lit("\\" + name))

    def escape(c: Column) -> Column:
        point = F.ascii(c)
        over = point - 0x10000
        unit16 = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
        return (
            F.when((point >= 32) & (point < 127) | (c == ""), c)
            .when(point < 0x10000, unit16(point))
            .otherwise(
                F.concat(
                    unit16(F.lit(0xD800) + F.shiftright(over, 10)),
                    unit16(F.lit(0xDC00) + over.bitwiseAND(0x3FF)),
                )
            )
        )

    escaped = F.array_join(F.transform(F.split(plain, ""), escape), "")
    body = F.when(plain.rlike(r"^[ -~]*$"), plain).otherwise(escaped)
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_list(*values: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *[json_text(v) for v in values]), F.lit("]"))


def edge_digest(relation, src, dst, src_anchor, dst_anchor) -> Column:
    """16 hex digits naming an edge; anchors print as ``(s, e)`` or ``None``."""

    def shown(anchor: Column) -> Column:
        return F.when(anchor.isNull(), F.lit("None")).otherwise(
            F.format_string("(%d, %d)", anchor["start"], anchor["end"])
        )

    payload = F.concat_ws("|", relation, src, dst, shown(src_anchor), shown(dst_anchor))
    return F.substring(content_hash(payload), 1, 16)
