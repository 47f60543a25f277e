"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from strandloom.functions.encoding import BASES, LETTERS

M64 = "18446744073709551615::uhugeint"
C1, C2 = "9782798678568883157::uhugeint", "5545529020109919103::uhugeint"
F1, F2 = "18397679294719823053::uhugeint", "14181476777654086739::uhugeint"


def dna(table: str = "documents", rec: str = "doc_id") -> str:
    return f"SELECT {rec} AS rec, translate(translate(regexp_replace(text, '[^A-Za-z\\n]', '', 'g'), '{LETTERS}', '{BASES}'), chr(10), 'N') AS s FROM {table}"


def windows(k: int, table: str = "dna") -> str:
    """(rec, pos, n, kmer) of all windows, breaks included."""
    return f"SELECT rec, pos, length(s) AS n, substr(s, pos + 1, {k}) AS kmer FROM (SELECT rec, s, unnest(range(0, greatest(0, length(s) - {k - 1}))) AS pos FROM {table})"


def kmers(k: int, table: str = "dna") -> str:
    return f"SELECT rec, pos, n, kmer FROM ({windows(k, table)}) WHERE kmer NOT LIKE '%N%'"


def canonical(x: str) -> str:
    return f"least({x}, translate(reverse({x}), 'ACGT', 'TGCA'))"


def pack(x: str, k: int) -> str:
    return "(" + " + ".join(f"(strpos('ACGT', substr({x}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k)) + ")::BIGINT"


def pack_wide(x: str, k: int) -> str:
    """The same as an unsigned number of up to 64 bits."""
    return "(" + " + ".join(f"(strpos('ACGT', substr({x}, {i + 1}, 1)) - 1)::uhugeint * {4 ** (k - 1 - i)}::uhugeint" for i in range(k)) + ")"


def signed(h: str) -> str:
    return f"(CASE WHEN {h} >= 9223372036854775808::uhugeint THEN {h}::hugeint - 18446744073709551616::hugeint ELSE {h}::hugeint END)::BIGINT"


def unsigned(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN {x}::hugeint + 18446744073709551616::hugeint ELSE {x}::hugeint END)::uhugeint"


def _mul(a: str, b: str) -> str:
    return f"(({a} * {b}) & {M64})"


def hashed(source: str, x: str, seed: int, name: str = "hv") -> str:
    """CTEs ending in ``name``: the columns of source, with h1 and h2, both words for the uhugeint x."""
    mix = lambda c: f"xor({c}, {c} >> 33)"
    steps = [
        f"{name}0 AS (SELECT *, {_mul(x, C1)} AS k FROM {source})",
        f"{name}1 AS (SELECT * EXCLUDE (k), {_mul(f'(((k << 31) & {M64}) | (k >> 33))', C2)} AS k FROM {name}0)",
        f"{name}2 AS (SELECT * EXCLUDE (k), (xor(xor({seed}::uhugeint, k), 8::uhugeint) + {seed ^ 8}::uhugeint) & {M64} AS a, {seed ^ 8}::uhugeint AS b FROM {name}1)",
        f"{name}3 AS (SELECT * EXCLUDE (a, b), {mix('a')} AS a, (b + a) & {M64} AS b FROM {name}2)",
        f"{name}4 AS (SELECT * EXCLUDE (a, b), {_mul('a', F1)} AS a, {mix('b')} AS b FROM {name}3)",
        f"{name}5 AS (SELECT * EXCLUDE (a, b), {mix('a')} AS a, {_mul('b', F1)} AS b FROM {name}4)",
        f"{name}6 AS (SELECT * EXCLUDE (a, b), {_mul('a', F2)} AS a, {mix('b')} AS b FROM {name}5)",
        f"{name}7 AS (SELECT * EXCLUDE (a, b), {mix('a')} AS a, {_mul('b', F2)} AS b FROM {name}6)",
        f"{name}8 AS (SELECT * EXCLUDE (b), {mix('b')} AS b FROM {name}7)",
        f"{name} AS (SELECT * EXCLUDE (a, b), (a + b) & {M64} AS h1, (b + ((a + b) & {M64})) & {M64} AS h2 FROM {name}8)",
    ]
    return ", ".join(steps)


def hashed_bytes(source: str, text: str, seed: int, name: str = "hb") -> str:
    """CTEs ending in ``name``: the columns of source, with h1 for an ASCII text of at most 15 bytes."""
    part = lambda a: "(" + " + ".join(f"coalesce(unicode(nullif(substr({text}, {a + i + 1}, 1), ''))::uhugeint * {256**i}::uhugeint, 0::uhugeint)" for i in range(8)) + ")"
    turn = lambda x, r: f"((({x} << {r}) & {M64}) | ({x} >> {64 - r}))"
    mix = lambda c: f"xor({c}, {c} >> 33)"
    size = f"length({text})::uhugeint"
    steps = [
        f"{name}0 AS (SELECT *, {_mul(part(0), C1)} AS a, {_mul(part(8), C2)} AS b FROM {source})",
        f"{name}1 AS (SELECT * EXCLUDE (a, b), xor(xor({seed}::uhugeint, {_mul(turn('a', 31), C2)}), {size}) AS a, xor(xor({seed}::uhugeint, {_mul(turn('b', 33), C1)}), {size}) AS b FROM {name}0)",
        f"{name}2 AS (SELECT * EXCLUDE (a), (a + b) & {M64} AS a FROM {name}1)",
        f"{name}3 AS (SELECT * EXCLUDE (a, b), {mix('a')} AS a, {mix(f'((b + a) & {M64})')} AS b FROM {name}2)",
        f"{name}4 AS (SELECT * EXCLUDE (a, b), {_mul('a', F1)} AS a, {_mul('b', F1)} AS b FROM {name}3)",
        f"{name}5 AS (SELECT * EXCLUDE (a, b), {mix('a')} AS a, {mix('b')} AS b FROM {name}4)",
        f"{name}6 AS (SELECT * EXCLUDE (a, b), {_mul('a', F2)} AS a, {_mul('b', F2)} AS b FROM {name}5)",
        f"{name} AS (SELECT * EXCLUDE (a, b), ({mix('a')} + {mix('b')}) & {M64} AS h1 FROM {name}6)",
    ]
    return ", ".join(steps)


def hashed_x86(source: str, x: str, seed: int, name: str = "hx") -> str:
    """CTEs ending in ``name``: the columns of source, with h32 and the four lanes g1 to g4 for the uhugeint x of 64 bits."""
    m = "4294967295::uhugeint"
    n = lambda v: f"{v}::uhugeint"
    mul = lambda a, b: f"(({a} * {n(b)}) & {m})"
    rot = lambda a, r: f"((({a} << {r}) & {m}) | ({a} >> {32 - r}))"
    low, high = f"({x} & {m})", f"({x} >> 32)"
    steps = [f"SELECT *, {mul(low, 0xCC9E2D51)} AS p, {mul(high, 0xCC9E2D51)} AS q, {mul(low, 0x239B961B)} AS a, {mul(high, 0xAB0E9789)} AS b FROM {source}"]
    add = lambda cols, **new: steps.append(f"SELECT * EXCLUDE ({cols}), " + ", ".join(f"{v} AS {k}" for k, v in new.items()))
    add("p, q, a, b", p=mul(rot("p", 15), 0x1B873593), q=mul(rot("q", 15), 0x1B873593), a=mul(rot("a", 15), 0xAB0E9789), b=mul(rot("b", 16), 0x38B34AE5))
    add("p, a, b", p=f"xor({n(seed)}, p)", a=f"xor(xor({n(seed)}, a), {n(8)})", b=f"xor(xor({n(seed)}, b), {n(8)})", c=n(seed ^ 8))
    add("p, q", p=f"xor(({rot('p', 13)} * {n(5)} + {n(0xE6546B64)}) & {m}, q)")
    add("p", p=f"xor(({rot('p', 13)} * {n(5)} + {n(0xE6546B64)}) & {m}, {n(8)})")
    add("a", a=f"((a + b + c + c) & {m})", d="c")
    add("b, c, d", b=f"((b + a) & {m})", c=f"((c + a) & {m})", d=f"((d + a) & {m})")
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        add("p, a, b, c, d", **{v: mul(f"xor({v}, {v} >> {shift})", by) for v in "pabcd"})
    add("a", a=f"((a + b + c + d) & {m})")
    add("p, a, b, c, d", h32="p", g1="a", g2=f"((b + a) & {m})", g3=f"((c + a) & {m})", g4=f"((d + a) & {m})")
    out = [f"{name}0 AS ({steps[0]})"]
    for i, step in enumerate(steps[1:], 1):
        out.append(f"{name}{i if i < len(steps) - 1 else ''} AS ({step} FROM {name}{i - 1})")
    return ", ".join(out)


def minima(k: int, m: int, seed: int, both_strands: bool = False) -> str:
    """CTEs ending in ``mins``: (rec, seg, kpos, mpos, mmer, h) of each k-mer without a break.

    m-mers are ranked by hash, so that a window's least is a minimum of small integers.
    """
    w = k - m + 1
    mm = f"SELECT rec, pos, n, {canonical('kmer')} AS kmer FROM ({kmers(m)})" if both_strands else kmers(m)
    return f"""dna AS ({dna()}), mm AS ({mm}),
dist AS (SELECT DISTINCT kmer AS mmer, {pack('kmer', m)}::uhugeint AS x FROM mm),
{hashed('dist', 'x', seed)},
ranked AS (SELECT mmer, h1, row_number() OVER (ORDER BY h1) AS rk FROM hv),
mh AS (SELECT rec, pos, rk, pos - row_number() OVER (PARTITION BY rec ORDER BY pos) AS seg FROM mm JOIN ranked ON mm.kmer = ranked.mmer),
win AS (SELECT rec, seg, pos - {w - 1} AS kpos, min(rk * 4294967296 + pos) OVER f AS key, count(*) OVER f AS n FROM mh WINDOW f AS (PARTITION BY rec, seg ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)),
mins AS (SELECT rec, seg, kpos, key % 4294967296 AS mpos, mmer, h1 AS h FROM win JOIN ranked ON rk = key // 4294967296 WHERE n = {w})"""
