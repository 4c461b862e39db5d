"""SQL (DuckDB) for the queries of this subpackage whose whole result SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
         FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
         FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, t.item_id FROM dwin d JOIN iwin t ON d.n = t.n AND d.g = t.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(found.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(found.ids, '')) AS items_sha256, words.n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES: dict[str, str] = {"op5_decontamination": OP5}

_KEY = _LOWER.format(r"trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

OP9 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS p FROM d),
k AS (SELECT doc_id, l, p, {_KEY} AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.l, k.p, coalesce(f.first < k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLES["op9_line_dedup"] = OP9

# Exact near-duplicate groups by a walk over all linked texts: too slow for SQL on whole tables (brute force in tests).


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII string: -1 shifts by a bit, other numbers are bytes to take in."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_value(ord(substr({text}, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1)))"
    return (f"xor(4294967295, list_reduce(list_concat(list_value(4294967295), {steps}), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) "
            "WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))")


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, tree: str, count: int) -> str:
    """Nodes of each level above the table ``name``0 (tree, i, h, n), and the runs that they stand for."""
    out = []
    for k in range(count):
        out.append(f"""{name}r{k} AS (SELECT {tree}, i // 16 AS i, any_value(n) AS n, list(h ORDER BY i) AS run FROM {name}{k} GROUP BY {tree}, i // 16),
{name}{k + 1} AS (SELECT {tree}, i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h, (n + 15) // 16 AS n FROM {name}r{k})""")
    return ",\n".join(out)


def _proof(levels: list[tuple[str, str, str]]) -> str:
    """CTEs p0 .. pk that walk up the runs: siblings so far, and the digest folded from the leaf."""
    out = []
    for k, (runs, tree, place) in enumerate(levels):
        at = f"(({place}) % 16)"
        others = f"array_to_string(list_concat(r.run[1:{at}], r.run[{at} + 2:]), '')"
        folded = f"sha256(array_to_string(list_concat(r.run[1:{at}], list_value(p.folded), r.run[{at} + 2:]), ''))"
        out.append(f"""p{k + 1} AS (SELECT p.* EXCLUDE (sib, folded), CASE WHEN r.n > 1 THEN p.sib || {others} ELSE p.sib END AS sib,
CASE WHEN r.n > 1 THEN {folded} ELSE p.folded END AS folded FROM p{k} p JOIN {runs} r ON {tree} AND r.i = ({place}) // 16)""")
    return ",\n".join(out)


_LEAF_LEVELS, _SOURCE_LEVELS = 8, 5  # 16 to the power of these: more leaves and sources than any table here has

OP11 = f"""
WITH leaves AS (SELECT doc_id, coalesce('s' || source, '') AS src, {_leaf("text")} AS leaf,
                CASE WHEN coalesce({_crc32("coalesce(doc_id, 0)::VARCHAR")} % 5 = 0 AND doc_id IS NOT NULL, false)
                THEN {_leaf(_LOWER.format("text"))} ELSE {_leaf("text")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM leaves),
a0 AS (SELECT src, i, leaf AS h, n FROM placed),
{_levels("a", "src", _LEAF_LEVELS)},
subroots AS (SELECT src, h, row_number() OVER (ORDER BY src) - 1 AS i, count(*) OVER () AS n FROM a{_LEAF_LEVELS}),
b0 AS (SELECT 0 AS one, i, h, n FROM subroots),
{_levels("b", "one", _SOURCE_LEVELS)},
p0 AS (SELECT placed.doc_id, placed.src, placed.i, placed.leaf, s.h AS subroot, s.i AS j, '' AS sib, placed.changed AS folded
       FROM placed JOIN subroots s ON placed.src = s.src),
{_proof([(f"ar{k}", "r.src = p.src", f"p.i // {16 ** k}") for k in range(_LEAF_LEVELS)]
        + [(f"br{k}", "r.one = 0", f"p.j // {16 ** k}") for k in range(_SOURCE_LEVELS)])}
SELECT doc_id, leaf, subroot, b.h AS root, sha256(sib) AS proof_sha256, folded AS folded_root, folded = b.h AS verified
FROM p{_LEAF_LEVELS + _SOURCE_LEVELS}, b{_SOURCE_LEVELS} b
"""

ORACLES["op11_merkle"] = OP11


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _edit(state: int, cost: str, edit: str) -> str:
    return f"{{'c': st[{state}].c + ({cost}), 'e': st[{state}].e || {edit}}}"


# States of the grammar: 1 nothing yet, 2 after s, 3 after u, 4 after a; each the cheapest cost and its ASCII-least audit.
_EXTRA = "CASE r.f WHEN 'truncated' THEN 3 WHEN 'gone' THEN 100000000 ELSE 0 END"
_AS = {role: (f"{_EXTRA} + CASE WHEN r.i = '{role}' THEN 0 ELSE 3 END", f"CASE WHEN r.i = '{role}' THEN 'K' ELSE 'R' END") for role in "ua"}
_SYSTEM_KEPT = f"{_EXTRA} + CASE WHEN r.i = 's' THEN 0 ELSE 100000000 END"
_INSERTS = f"[st[1], st[2], {_least('st[3]', *(_edit(k, '3', repr('I')) for k in (1, 2, 4)))}, {_least('st[4]', _edit(3, '3', repr('I')), *(_edit(k, '6', repr('II')) for k in (1, 2)))}]"
_TURN = (f"[{_edit(1, '4', repr('D'))}, {_least(_edit(2, '4', repr('D')), _edit(1, _SYSTEM_KEPT, repr('K')))}, "
         f"{_least(_edit(3, '4', repr('D')), *(_edit(k, *_AS['u']) for k in (1, 2, 4)))}, {_least(_edit(4, '4', repr('D')), _edit(3, *_AS['a']))}]")

OP12 = f"""
WITH c AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
      CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
      unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
      FROM (SELECT *, {_crc32("k")} % 20 AS code FROM c) WHERE code <> 0),
o AS (SELECT coalesce(conv_id::VARCHAR, '') AS ck, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
      sha256(length(role) || ':' || role || text) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS rn FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY ck, h ORDER BY rn) AS nth, substr(role, 1, 1) AS i FROM o),
f AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN substr(t, -1, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      lag(i) OVER (PARTITION BY ck ORDER BY rn) || i NOT IN ('su', 'ua', 'au') AS bad FROM n),
s AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank')::BIGINT AS blank,
      count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate, count(*) FILTER (fault = 'truncated')::BIGINT AS truncated, count(*) FILTER (bad)::BIGINT AS illegal,
      list({{'i': i, 'f': CASE WHEN fault IN ('blank', 'duplicate') THEN 'gone' ELSE fault END}} ORDER BY rn) AS turns FROM f GROUP BY ck),
w AS (SELECT * EXCLUDE (turns), list_reduce(list_concat(flatten(list_transform(turns, lambda t: [{{'i': '', 'f': 'insert'}}, t])), [{{'i': '', 'f': 'insert'}}]),
      lambda st, r: CASE WHEN r.f = 'insert' THEN {_INSERTS} ELSE {_TURN} END,
      [{{'c': 0::BIGINT, 'e': ''}}, {{'c': 100000000::BIGINT, 'e': ''}}, {{'c': 100000000::BIGINT, 'e': ''}}, {{'c': 100000000::BIGINT, 'e': ''}}]) AS st FROM s),
b AS (SELECT * EXCLUDE (st), {_least("st[1]", "st[4]")} AS best FROM w),
e AS (SELECT ck, idx, substr(best.e, idx, 1) AS e FROM (SELECT ck, best, unnest(range(1, length(best.e) + 1)) AS idx FROM b)),
p AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY ck ORDER BY idx) AS rn, count(*) FILTER (e <> 'D') OVER (PARTITION BY ck ORDER BY idx)
      - (count(*) FILTER (e <> 'D') OVER (PARTITION BY ck)) % 2 AS place FROM e),
r AS (SELECT p.ck, string_agg(CASE WHEN e = 'K' THEN f.role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END,
      chr(10) ORDER BY idx) AS whole FROM p LEFT JOIN f ON p.ck = f.ck AND p.rn = f.rn WHERE e <> 'D' GROUP BY p.ck),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN b ON coalesce(conv_id::VARCHAR, '') = b.ck LEFT JOIN r ON b.ck = r.ck
"""

ORACLES["op12_conversation_repair"] = OP12
