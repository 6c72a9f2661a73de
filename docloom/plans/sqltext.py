"""DuckDB expressions that state the chunking rules once more, for the oracle."""

from __future__ import annotations

ENDS = "。！？!?；;"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def windows(x: str) -> str:
    return f"list_transform(range(0, length({x}), 820), lambda wi: substr({x}, wi + 1, 900))"


def cut(x: str) -> str:
    sentences = f"list_filter(regexp_extract_all({x}, '(?s)[^{ENDS}]*[{ENDS}]|[^{ENDS}]+'), lambda se: {strip('se')} <> '')"
    start = "{'done': []::varchar[], 'cur': ''}"
    lead = "(case when length(ca.cur) > 80 then right(ca.cur, 80) else '' end)"
    step = (
        "case when length(ca.cur) + length(cb.cur) > 900 and ca.cur <> '' "
        f"then {{'done': list_append(ca.done, ca.cur), 'cur': {lead} || cb.cur}} else {{'done': ca.done, 'cur': ca.cur || cb.cur}} end"
    )
    fold = f"list_reduce(list_transform({sentences}, lambda sx: {{'done': []::varchar[], 'cur': sx}}), lambda ca, cb: {step}, {start})"
    pieces = let(fold, "cr", "case when cr.cur <> '' then list_append(cr.done, cr.cur) else cr.done end")
    return f"flatten(list_transform({pieces}, lambda cp: case when length(cp) > 1200 then {windows('cp')} else [cp] end))"


def pack(parts: str) -> str:
    start = "{'done': []::varchar[], 'cur': null::varchar, 'n': 0::bigint}"
    item = "{'done': []::varchar[], 'cur': px, 'n': length(px) + 2}"
    step = (
        "case when pa.n + pb.n > 1200 and pa.cur is not null then {'done': list_append(pa.done, pa.cur), 'cur': pb.cur, 'n': pb.n} "
        "else {'done': pa.done, 'cur': case when pa.cur is null then pb.cur else pa.cur || chr(10) || chr(10) || pb.cur end, 'n': pa.n + pb.n} end"
    )
    fold = f"list_reduce(list_transform({parts}, lambda px: {item}), lambda pa, pb: {step}, {start})"
    return let(fold, "pr", "case when pr.cur is not null then list_append(pr.done, pr.cur) else pr.done end")


def split(x: str) -> str:
    found = f"list_filter(list_transform(regexp_split_to_array({x}, '\\n\\s*\\n'), lambda pp: {strip('pp')}), lambda pq: pq <> '')"
    return pack(f"flatten(list_transform({found}, lambda po: case when length(po) > 1200 then {cut('po')} else [po] end))")


def fit(x: str) -> str:
    return f"case when length({x}) > 1200 then {split(x)} else [{x}] end"


def plain(x: str) -> str:
    joined = f"array_to_string(list_transform(regexp_split_to_array({x}, '\\r\\n|[\\n\\r]'), lambda li: {strip('li')}), chr(10))"
    paragraphs = f"list_filter(regexp_split_to_array({joined}, '\\n\\n+'), lambda pg: {strip('pg')} <> '')"
    return f"flatten(list_transform({paragraphs}, lambda pt: {let(strip('pt'), 'pu', fit('pu'))}))"
