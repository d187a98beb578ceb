"""Jump consistent hashing: stable keys to shards without a ring table.

Lamping and Veach's jump hash needs a generator seeded by the key. Its 64-bit multiplication wraps, which bigint
arithmetic refuses, so a step is taken in decimals. All of it is one column expression.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.numbering import running_before, runs_for

# Fixed values of the published algorithm: the multiplier of the generator, and 2^31 and 2^33 that take its high bits.
MULTIPLIER = 2862933555777941757
HIGH = 1 << 31
DROPPED = 1 << 33

_WORD = "decimal(20,0)"
_USUAL_JUMPS = 40


def _jump(state: Column, shards: int) -> Column:
    product = state["key"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
    key = (product % F.lit(str(1 << 64)).cast(_WORD)).cast(_WORD)
    high = F.floor(key / F.lit(str(DROPPED)).cast("decimal(10,0)")).cast("double")
    to = F.floor((state["next"] + 1).cast("double") * (F.lit(float(HIGH)) / (high + 1.0))).cast("bigint")
    moved = F.struct(key.alias("key"), state["next"].alias("at"), to.alias("next"))
    return F.when(state["next"] < shards, moved).otherwise(state)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of an integer key; a null key counts as 0.

    With one shard more, a key stays where it is or goes into the new one, with probability 1 / (shards + 1).
    Other key types are hashed to a bigint by the caller, for example with ``xxhash64``.

    A key jumps about log(shards) times and at most ``shards`` times: forty steps are taken for every key, and the
    rest only by keys that have not arrived by then.
    """
    if shards < 1:
        raise ValueError("shards has to be 1 or more")
    word = F.coalesce(key.cast("bigint"), F.lit(0)).cast(_WORD)
    unsigned = F.when(word < 0, word + F.lit(str(1 << 64)).cast(_WORD)).otherwise(word).cast(_WORD)
    start = F.struct(unsigned.alias("key"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"))

    def walk(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda acc, _: _jump(acc, shards))

    most = min(shards, _USUAL_JUMPS)
    near = walk(start, most)
    if most == shards:
        return near["at"].cast("int")
    return F.when(near["next"] >= shards, near["at"]).otherwise(walk(near, shards - most)["at"]).cast("int")


def shard_rows(
    rows: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Shard and place of every row: key, size, text_crc32, shard, slot, grown_shard.

    - size: UTF-8 bytes of the text plus 1 (null text: 1); text_crc32: unsigned, 0 for an empty or null text.
    - slot: the row's place in its shard, gapless from 0. A shard is numbered in as many runs as the square
      root of the table's rows (run: key modulo their number), in the order of run and key, so no task holds a shard. Rows with the same
      key share a shard and take neighbouring slots in any order.
    - grown_shard: the shard if there were one more.
    - A null key counts as 0 and comes first in its run. Other columns of ``rows`` play no part, whatever their names.
      An empty table gives an empty result.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    placed = rows.select(
        F.col(key).cast("bigint").alias("key"),
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).cast("bigint").alias("text_crc32"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
    )
    runs = runs_for(rows.count())
    run = F.pmod(F.coalesce("key", F.lit(0)), F.lit(runs))
    numbered = running_before(placed, ["shard"], run, [F.col("key")], F.lit(1).cast("bigint"), "slot")
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")
