"""Judges URLs by host and path rules, then by a list of canonical URLs behind a blocked Bloom filter.

Everything is DataFrame functions. The filter is a table: a row for each block of 512 bits (eight
longs), built by OR-ing the listed URLs' bits. A URL reads the one block that its hash names; if its
bits are all set it is a possible hit and goes to an exact hash join with the list, which removes
false positives; all others never leave their task. Blocks are sized from the list's count, which is
what the size check of the broadcast looks at: up to `BROADCAST_URLS` listed URLs make a filter of a
few MB and a list of some tens of MB at most; beyond that blocks and list are joined by shuffle. Pages
are read and parsed once.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule, has an
empty canonical form and is never listed; very long URLs are read whole; nulls, empty strings and strings
that begin with a line feed in the list are ignored, repeats do
no harm; with an empty list every URL without a rule is allowed; an empty table gives no rows;
repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.shared import materialize

Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URLS_A_BLOCK = 32
PROBES = 8
LANES = 8
BROADCAST_URLS = 1_000_000


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The host without user and password, default port and a leading `www.`; the path with percent signs
    decoded (as it is where they aren't valid) and without trailing slashes."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@", ""), r":(80|443)?\z", ""), r"\Awww\.", "")
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.concat(bare, F.regexp_replace(plain, r"/+\z", ""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a domain above it, and begins the path."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("long")


def _masks(url: Column) -> list[Column]:
    """The bits of a URL in its block, a long for each lane: probe k sets one of 512 by 9 bits of a hash."""
    hashes = [F.xxhash64(url, F.lit(1)), F.xxhash64(url, F.lit(2))]
    spots = [F.shiftrightunsigned(hashes[k // 4], 9 * (k % 4)).bitwiseAND(F.lit(511)).cast("int") for k in range(PROBES)]
    one = F.lit(1).cast("long")
    bit = [F.when(F.shiftright(s, 6) == lane, F.call_function("shiftleft", one, s.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")) for lane in range(LANES) for s in spots]
    masks = []
    for lane in range(LANES):
        mask = bit[lane * PROBES]
        for b in bit[lane * PROBES + 1 : (lane + 1) * PROBES]:
            mask = mask.bitwiseOR(b)
        masks.append(mask)
    return masks


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of the URLs in column `listed`: block, w0 .. w7."""
    bits = listed.select(_block(F.col("listed"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("listed")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], hit: str = "block", miss: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict. `listed` has canonical URLs in its column `listed`."""
    listed = materialize(listed.where("listed <> '' and not startswith(listed, '\n')").select("listed").distinct(), "listed")
    count = listed.count()
    blocks = max(1, -(-count // URLS_A_BLOCK))
    read = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    read = read.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    asked = F.col("found").isNull() & (F.col("canonical") != "")
    # what isn't asked gets a key that none has, spread over all tasks
    aside = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 20))
    small = count <= BROADCAST_URLS
    filter_blocks, exact = bloom_blocks(listed, blocks), listed.withColumnRenamed("listed", "on_list")
    if small:
        filter_blocks, exact = F.broadcast(filter_blocks), F.broadcast(exact)
    probed = read.withColumn("block", F.when(asked, _block(F.col("canonical"), blocks)).otherwise(-1 - aside)).join(filter_blocks, "block", "left")
    possible = asked
    for i, mask in enumerate(_masks(F.col("canonical"))):
        possible = possible & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(mask) == mask)
    key = F.when(possible, F.col("canonical")).otherwise(F.concat(F.lit("\n"), aside.cast("string")))
    judged = probed.select("page_id", "host", "path", "found", key.alias("on_list")).join(exact.withColumn("hit", F.lit(True)), "on_list", "left")
    verdict = F.when(F.col("found").isNotNull(), F.col("found.verdict")).when(F.col("hit"), hit).otherwise(miss)
    return judged.select("page_id", "host", "path", "found.rule", verdict.alias("verdict"))
