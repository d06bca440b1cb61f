"""HMAC-SHA-256 and unambiguous texts from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # bytes per SHA-256 block


def _xor_pad(key_hex: Column, byte: int) -> Column:
    """Each byte of a block-long hex key xor `byte`, as hex."""
    one = lambda i: F.lpad(
        F.hex(F.conv(F.substring(key_hex, i * 2 - 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0"
    )
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), one), "")


def key_pads(keys: DataFrame) -> DataFrame:
    """(kid, ipad, opad) from (kid, secret_hex); the secret itself is not projected."""
    long_key = F.length("secret_hex") > BLOCK * 2
    normal = F.when(long_key, F.sha2(F.unhex("secret_hex"), 256)).otherwise(F.col("secret_hex"))
    block = keys.select("kid", F.rpad(normal, BLOCK * 2, "0").alias("block_hex"))
    # fixed values of the HMAC construction: 0x36 and 0x5c
    return block.select(
        "kid", F.unhex(_xor_pad(F.col("block_hex"), 0x36)).alias("ipad"),
        F.unhex(_xor_pad(F.col("block_hex"), 0x5C)).alias("opad"),
    )


def hmac_hex(message: Column, ipad: Column | str, opad: Column | str) -> Column:
    ipad = F.col(ipad) if isinstance(ipad, str) else ipad
    opad = F.col(opad) if isinstance(opad, str) else opad
    inner = F.unhex(F.sha2(F.concat(ipad, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(opad, inner), 256)


def length_prefixed(*fields: Column) -> Column:
    """Unambiguous text of several fields: `<length>:<field>` each, `-` for NULL."""
    return F.concat(
        *[F.coalesce(F.concat(F.length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    )
