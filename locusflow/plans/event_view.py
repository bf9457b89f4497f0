"""Orders as rearrangement events, for the rules; every value comes from the two keys by arithmetic that SQL has too."""

from __future__ import annotations

_n = iter(range(1000))


def _draw(m: int) -> str:
    k = next(_n)
    return f"((o_orderkey * {7919 + 2 * k} + o_custkey * {104729 + 38 * k}) % 99991 % {m})"


def _side(i: int) -> dict[str, str]:
    flag = lambda m: f"{_draw(m)} = 0"
    few = lambda m: f"{_draw(m)}"
    return {
        f"susp{i}": flag(40), f"sui{i}": flag(9), f"e{i}": few(4), f"m{i}": f"CAST({few(11)} AS DOUBLE) / 10", f"h{i}": f"greatest(0, {few(14)} - 5)", f"sup{i}": few(14), f"sec{i}": few(12),
        f"mate{i}": few(16), f"exp{i}": few(14), f"fuzzy{i}": flag(6), f"strict{i}": flag(6), f"cand{i}": flag(6), f"prone{i}": flag(10), f"comp{i}": flag(3), f"cl{i}": f"CAST({few(100)} AS DOUBLE) / 100",
        f"indel{i}": few(8), f"brk{i}": few(40), f"span{i}": few(30), f"ev{i}": few(20), f"bpmate{i}": few(5), f"status{i}": f"CASE WHEN {flag(12)} THEN 'EXTREME_SUBCLONAL' ELSE 'HETERO' END",
        f"germ{i}": flag(4), f"match{i}": flag(3), f"ctg{i}": f"CASE WHEN {flag(4)} THEN 999 ELSE {few(24)} + 1 END", f"over{i}": f"CAST({few(11)} AS DOUBLE) / 14",
    }


EVENT = {
    "semi": f"{_draw(9)} = 0", "distant": f"{_draw(3)} > 0", "inter": f"{_draw(3)} = 0", "inv": f"{_draw(3)} = 0", "size": f"{_draw(12000)}", "type": f"CASE WHEN {_draw(6)} = 0 THEN 'TRA' ELSE 'DEL' END",
    "artifact": f"CASE WHEN {_draw(8)} = 0 THEN 'ARTIFACT' ELSE 'CLEAN' END", **_side(1), **_side(2),
}
EV = f"ev AS (SELECT o_orderkey, {', '.join(f'{v} AS "{k}"' for k, v in EVENT.items())} FROM orders)"
