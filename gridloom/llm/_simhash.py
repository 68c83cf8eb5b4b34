"""SimHash votes and permuted block tables, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def votes(terms: list[tuple[str, int | str]], word: int = 0) -> list[Column]:
    """Sums over rows of weighted hash bits: 32 longs of two 32-bit lanes, bit j low and bit j + 32 high.

    terms are columns of 64-bit hashes, 0 where there is no term, with their weights, numbers or columns of
    longs. All votes for a bit must stay below 2 ** 31.
    """
    out = []
    for j in range(32):
        lanes = [F.shiftrightunsigned(name, j).bitwiseAND(F.lit(_LANES)) * (F.col(w) if isinstance(w, str) else F.lit(w).cast("long")) for name, w in terms]
        out.append(F.sum(sum(lanes[1:], lanes[0])).alias(f"v{word}_{j}"))
    return out


def fingerprint(total: str, word: int = 0) -> Column:
    """64 bits: those whose votes are more than half of the total."""
    parts = []
    for j in range(32):
        lane = f"v{word}_{j}"
        parts.append(f"CASE WHEN 2 * ({lane} & {_LOW}) > {total} THEN {1 << j}L ELSE 0L END")
        high = f"{1 << (j + 32)}L" if j < 31 else "-9223372036854775808"
        parts.append(f"CASE WHEN 2 * shiftrightunsigned({lane}, 32) > {total} THEN {high} ELSE 0L END")
    while len(parts) > 1:  # a balanced tree, not a chain
        parts = [f"({' | '.join(parts[k : k + 2])})" for k in range(0, len(parts), 2)]
    return F.expr(parts[0])


def tables(words: list[str], blocks: int, chosen: int) -> Column:
    """An array of long keys of 64-bit words' blocks: one for each choice of blocks, with the choice's number.

    Fingerprints that differ in at most blocks - chosen bits share a key: the differing bits touch at most
    that many blocks, and the others agree. A key is a hash of its masked words.
    """
    bits = 64 * len(words)
    edges = [bits * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, choice in enumerate(combinations(range(blocks), chosen)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in choice)
        masked = []
        for k, name in enumerate(words):
            part = mask >> 64 * k & ((1 << 64) - 1)
            part -= (1 << 64) * (part >> 63)
            masked.append(F.col(name).bitwiseAND(F.lit(part)))
        keys.append(F.xxhash64(F.lit(number), *masked))
    return F.array(*keys)


def distance(left: list[Column], right: list[Column]) -> Column:
    """Hamming distance of fingerprints."""
    out = None
    for a, b in zip(left, right):
        part = F.bit_count(a.bitwiseXOR(b))
        out = part if out is None else out + part
    return out
