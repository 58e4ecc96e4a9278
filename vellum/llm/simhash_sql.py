"""SimHash components in DuckDB's SQL: XXH64 by its published definition, majority fingerprints, links of all pairs, closure."""

from __future__ import annotations

_M = 1 << 64
#: The five primes of XXH64 (fixed public values).
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _u(n: int) -> str:
    return f"{n}::uhugeint"


def _mul(x: str, p: int) -> str:
    return f"(({x}) * {_u(p)} % {_u(_M)})"


def _rotl(x: str, r: int) -> str:
    return f"(({x}) * {_u(1 << r)} % {_u(_M)} + ({x}) // {_u(1 << 64 - r)})"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::ubigint, ({b})::ubigint)::uhugeint"


def _little(at: str, n: int) -> str:
    """n bytes from place `at` of the hexadecimal text x, the last one first."""
    return "('0x' || " + " || ".join(f"substr(x, (2 * ({at}) + {2 * j + 1})::bigint, 2)" for j in reversed(range(n))) + ")::ubigint::uhugeint"


def _round(acc: str, lane: str) -> str:
    return _mul(_rotl(f"(({acc}) + {_mul(lane, _P2)}) % {_u(_M)}", 31), _P1)


def _fold(first: str, items: str, step: str) -> str:
    return f"list_reduce(list_prepend({first}, {items}), lambda acc, l: {step})"


def xxh64(seed: int, source: str) -> str:
    """Common table expressions: a table of texts s -> xh (s, h), the XXH64 of their UTF-8 bytes."""
    lanes = [((seed + _P1 + _P2) % _M, 0), ((seed + _P2) % _M, 8), (seed, 16), ((seed - _P1) % _M, 24)]
    acc = ", ".join(f"{_fold(_u(first), f'list_transform(range(n // 32), lambda j: {_little(f"32 * j + {at}", 8)})', _round('acc', 'l'))} as a{at // 8}" for first, at in lanes)
    merged = f"({_rotl('a0', 1)} + {_rotl('a1', 7)} + {_rotl('a2', 12)} + {_rotl('a3', 18)}) % {_u(_M)} as m0, "
    merged += ", ".join(f"({_mul(_xor(f'm{i}', _round(_u(0), f'a{i}')), _P1)} + {_u(_P4)}) % {_u(_M)} as m{i + 1}" for i in range(4))
    eight = f"({_mul(_rotl(_xor('acc', _round(_u(0), 'l')), 27), _P1)} + {_u(_P4)}) % {_u(_M)}"
    four = f"({_mul(_rotl(_xor('h1', _mul(_little('p1', 4), _P1)), 23), _P2)} + {_u(_P3)}) % {_u(_M)}"
    return f"""x0 as (select s, hex(encode(s)) as x, strlen(s) as n from {source}),
x1 as (select *, {acc} from x0), x2 as (select *, {merged} from x1),
x3 as (select *, ((case when n < 32 then {_u((seed + _P5) % _M)} else m4 end) + n::uhugeint) % {_u(_M)} as h0, n // 32 * 32 as p0, p0 + (n - p0) // 8 * 8 as p1, case when n - p1 >= 4 then p1 + 4 else p1 end as p2,
  {_fold("h0", f"list_transform(range(p0, p1, 8), lambda j: {_little('j', 8)})", eight)} as h1, case when p2 > p1 then {four} else h1 end as h2,
  {_fold("h2", f"list_transform(range(p2, n), lambda j: {_little('j', 1)})", _mul(_rotl(_xor("acc", _mul("l", _P5)), 11), _P1))} as h3,
  {_mul(_xor("h3", f"h3 // {_u(1 << 33)}"), _P2)} as h4, {_mul(_xor("h4", f"h4 // {_u(1 << 29)}"), _P3)} as h5, {_xor("h5", f"h5 // {_u(1 << 32)}")} as h6 from x2),
xh as (select s, h6::ubigint as h from x3)"""


_BITS = " + ".join(f"case when 2 * count_if(h // {1 << b}::ubigint % 2 = 1) > count(*) then {1 << b}::uhugeint else 0::uhugeint end" for b in range(64))
_CAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE = f"""with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_CAPS}', '{_CAPS.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
g as (select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from d),
source as (select distinct s from g), {xxh64(42, "source")},
f as (select doc_id, ({_BITS})::ubigint as fp from g join xh using (s) group by doc_id),
p as (select doc_id, coalesce(fp, 0) as fp from documents left join f using (doc_id)),
u as (select fp, min(doc_id) as least from p group by fp),
link as (select a.fp as a, b.fp as b from u a, u b where a.fp <> b.fp and bit_count(xor(a.fp, b.fp)::hugeint) <= 4),
reach(a, b) as (select fp, fp from u union select reach.a, link.b from reach join link on reach.b = link.a),
c as (select reach.a as fp, min(least) as component_id from reach join u on u.fp = reach.b group by reach.a)
select doc_id, lower(printf('%016x', p.fp)) as fingerprint, component_id from p join c using (fp)"""
