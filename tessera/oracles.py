"""The queries in SQL for another engine, written on their own: relational throughout, without this package's kernels."""

from __future__ import annotations


def _h(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def _with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


_CELLS = "SELECT vec_id AS locus, CAST(unnest(range(len(embedding))) AS INTEGER) AS ind, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
GENO = f"""geno AS (SELECT locus, ind, CAST(CASE WHEN {_h("concat('miss:', locus, ':', ind)")} % 50 = 0 THEN -9
  WHEN x < 0.0 THEN 0 WHEN x < 0.12 THEN 1 ELSE 2 END AS INTEGER) AS mac FROM ({_CELLS}))"""
FLIP = """flip AS (SELECT locus, CAST(count(*) FILTER (mac > 0) AS INTEGER) AS n_carrier, CAST(count(*) FILTER (mac >= 0) AS INTEGER) AS n_called,
  2 * count(*) FILTER (mac > 0) > count(*) FILTER (mac >= 0) AS flip FROM geno GROUP BY locus)"""
_COIN = f"{_h("concat('het:0:', locus, ':', ind)")} % 2"
BITS = f"""bits AS (SELECT locus, ind FROM geno JOIN flip USING (locus) WHERE mac >= 0
  AND (CASE WHEN mac = 0 THEN 0 WHEN mac % 2 = 1 THEN {_COIN} ELSE 1 END = 1) <> flip)"""
GENO_BITS = (GENO, FLIP, BITS)
WORDS = f"""bits AS (SELECT DISTINCT doc_id AS locus, CAST({_h("w")} % 8192 AS INTEGER) AS ind FROM
  (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents) WHERE w <> '')"""


def _pads(n: int, k: int) -> str:
    padded = k * -(-n // k)
    return f"pads AS (SELECT CAST(p AS BIGINT) AS pad_pos, {_h("concat('pad:0:', p)")} % {n} AS src_ind FROM range({n}, {padded}) t(p))"


def _places(n: int, k: int) -> tuple[str, ...]:
    padded = k * -(-n // k)
    return (
        _pads(n, k),
        f"perm AS (SELECT i, row_number() OVER (ORDER BY {_h("concat('perm:0:', i)")}, i) - 1 AS pos FROM range({padded}) t(i))",
        """placed AS (SELECT locus, pos FROM bits JOIN perm ON ind = i
  UNION ALL SELECT locus, pos FROM bits JOIN pads ON ind = src_ind JOIN perm ON i = pad_pos)""",
    )


def _sketch(n: int, k: int) -> tuple[str, ...]:
    size = -(-n // k)
    return (*_places(n, k), f"sk AS (SELECT locus, CAST(pos // {size} AS INTEGER) AS bin, CAST(min(pos % {size}) AS INTEGER) AS v FROM placed GROUP BY ALL)")


def _dense(n: int, k: int) -> tuple[str, ...]:
    """Densified sketches as ``dense(locus, acc)``: one round of fills at a time until no bin is empty."""
    giver = "list_filter(range(0, {k}), lambda i: orig[i + 1] IS NOT NULL AND acc[tgt[i + 1] + 1] IS NULL)[1]".format(k=k)
    step = f"""SELECT locus, t + 1 AS t, orig, CASE WHEN g IS NULL THEN acc ELSE
      list_transform(range(0, {k}), lambda j: CASE WHEN j = tgt[g + 1] THEN orig[g + 1] ELSE acc[j + 1] END) END AS acc
    FROM (SELECT *, {giver} AS g FROM d JOIN tg USING (t) WHERE list_count(acc) < {k})"""
    return (
        *_sketch(n, k),
        f"tg AS (SELECT t, list({_h("concat('fill:0:', t, ':', i)")} % {k} ORDER BY i) AS tgt FROM range({32 * k}) a(t), range({k}) b(i) GROUP BY t)",
        f"""arr AS (SELECT locus, list(v ORDER BY bin) AS orig FROM (SELECT l.locus, b.bin, sk.v FROM (SELECT DISTINCT locus FROM sk) l
  CROSS JOIN range({k}) b(bin) LEFT JOIN sk ON sk.locus = l.locus AND sk.bin = b.bin) GROUP BY locus)""",
        f"d AS (SELECT locus, CAST(0 AS BIGINT) AS t, orig, orig AS acc FROM arr UNION ALL {step})",
        f"dense AS (SELECT locus, acc FROM d WHERE list_count(acc) = {k})",
    )


def _cells(k: int) -> str:
    return f"cells AS (SELECT locus, CAST(unnest(range({k})) AS INTEGER) AS bin, unnest(acc) AS v FROM dense)"


GENO_DENSE = (*GENO_BITS, *_dense(64, 16), _cells(16))
TEXT_DENSE = (WORDS, *_dense(8192, 64), _cells(64))
KEYS = "keyed AS (SELECT locus, CAST(bin // 4 AS INTEGER) AS band, string_agg(CAST(v AS VARCHAR), ',' ORDER BY bin) AS key FROM cells GROUP BY locus, bin // 4)"
BUCKETS = """buckets AS (SELECT band, key, min(locus) AS first_locus, string_agg(CAST(locus AS VARCHAR), ',' ORDER BY locus) AS loci_txt, count(*) AS n
  FROM keyed GROUP BY band, key HAVING count(*) > 1)"""
MEMBERS = "members AS (SELECT DISTINCT first_locus, locus FROM keyed JOIN buckets USING (band, key))"
SIZES = "sizes AS (SELECT first_locus, count(*) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_pairs FROM members GROUP BY first_locus)"
GROUPED = (*TEXT_DENSE, KEYS, BUCKETS, MEMBERS, SIZES)
EXACT = """counted AS (SELECT locus, count(*) AS n FROM bits GROUP BY locus),
loci AS (SELECT DISTINCT locus, coalesce(n, 0) AS n FROM geno LEFT JOIN counted USING (locus)),
shared AS (SELECT a.locus AS a, b.locus AS b, count(*) AS i FROM bits a JOIN bits b ON a.ind = b.ind AND b.locus < a.locus GROUP BY ALL),
exact AS (SELECT x.locus AS row, y.locus AS col, coalesce(i, 0) AS n_intersect, x.n + y.n - coalesce(i, 0) AS n_union
  FROM loci x JOIN loci y ON y.locus < x.locus LEFT JOIN shared ON a = x.locus AND b = y.locus WHERE x.n + y.n > 0)"""


def _q(i: str, u: str) -> str:
    return f"CAST(255 * {i} // {u} AS INTEGER)"


def _printed(q: str) -> str:
    return f"printf('%.4f', {q} / CAST(255 AS DOUBLE))"


def _equal(k: int, pairs: str) -> str:
    return f"equal AS (SELECT a.locus AS row, b.locus AS col, CAST(count(*) FILTER (a.v = b.v) AS INTEGER) AS n_eq FROM {pairs} GROUP BY ALL)"


_ALL = "cells a JOIN cells b ON a.bin = b.bin AND b.locus < a.locus"
_LISTED = f"SELECT row + 1 AS locus1, col + 1 AS locus2, {_printed(_q('n_eq', '{k}'))} AS jaccard FROM equal WHERE n_eq / CAST({{k}} AS DOUBLE) >= {{cut}}"
_IN_GROUPS = """pairs AS (SELECT DISTINCT a.locus AS x, b.locus AS y FROM members a JOIN members b USING (first_locus) WHERE b.locus < a.locus)"""
_COUNTED = """counted AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_linenumber AS line, l_partkey AS r, l_suppkey AS c, CAST(l_linenumber AS BIGINT) AS i,
  l_linenumber + CAST(floor(l_quantity) AS BIGINT) AS u FROM lineitem WHERE l_partkey <> l_suppkey)"""
_SORTED = "SELECT greatest(r, c) AS row, least(r, c) AS col, k, i, u, line FROM counted"


def _inserted(lines: str) -> str:
    return f"SELECT row, col, arg_min({_q('i', 'u')}, k) AS q FROM ({_SORTED} WHERE {lines}) GROUP BY row, col"


#: Row and column of all indexes that the queries use, by counting instead of by a root.
TRIANGLE = "tri AS (SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, CAST(r * (r - 1) // 2 + c AS BIGINT) AS vec_idx FROM range(1, 150) a(r), range(0, 149) b(c) WHERE c < r)"


def _murmur(value: str, seed: int) -> str:
    """Nested selects, one a step of the public algorithm, so that no step's text is repeated."""
    m = 0xFFFFFFFF
    times = lambda x, c: f"({x} * {c & 0xFFFF} + ((({x} * {c >> 16}) & 65535) << 16)) & {m}"
    turn = lambda x, n: f"((({x} << {n}) & {m}) | ({x} >> {32 - n}))"
    inner = f"SELECT p_partkey AS value, CAST({seed} AS BIGINT) AS h FROM part"
    for block in (f"({value} & {m})", f"({value} >> 32)"):
        inner = f"SELECT value, h, {times(block, 0xCC9E2D51)} AS b FROM ({inner})"
        inner = f"SELECT value, h, {turn('b', 15)} AS b FROM ({inner})"
        inner = f"SELECT value, xor(h, {times('b', 0x1B873593)}) AS h FROM ({inner})"
        inner = f"SELECT value, ({turn('h', 13)} * 5 + {0xE6546B64}) & {m} AS h FROM ({inner})"
    inner = f"SELECT value, xor(h, 8) AS h FROM ({inner})"
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        inner = f"SELECT value, xor(h, h >> {shift}) AS h FROM ({inner})"
        inner = f"SELECT value, {times('h', factor)} AS h FROM ({inner})"
    return f"SELECT value, xor(h, h >> 16) AS hash FROM ({inner})"


def _murmur_list(blocks: str, seed: int = 2153025618) -> str:
    """Blocks of one vector after the other, by recursion over their places; each is followed by a block of zero."""
    m = 0xFFFFFFFF
    times = lambda x, c: f"({x} * {c & 0xFFFF} + ((({x} * {c >> 16}) & 65535) << 16)) & {m}"
    turn = lambda x, n: f"(((({x}) << {n}) & {m}) | (({x}) >> {32 - n}))"
    step = lambda x: f"(({turn(x, 13)} * 5 + {0xE6546B64}) & {m})"
    mixed = [
        "v AS (SELECT l_orderkey AS locus, list(l_partkey ORDER BY l_linenumber, l_partkey) AS xs FROM lineitem GROUP BY l_orderkey)",
        f"w AS (SELECT locus, {blocks} AS ys FROM v)",
        f"b AS (SELECT locus, ys, list_transform(list_transform(list_transform(ys, lambda y: {times('y', 0xCC9E2D51)}), lambda y: {turn('y', 15)}), lambda y: {times('y', 0x1B873593)}) AS bs FROM w)",
        f"""s AS (SELECT locus, bs, CAST(0 AS BIGINT) AS k, CAST({seed} AS BIGINT) AS h FROM b
  UNION ALL SELECT locus, bs, k + 1, {step("h")} FROM (SELECT locus, bs, k, {step("xor(h, bs[k + 1])")} AS h FROM s WHERE k < len(bs)))""",
    ]
    inner = "SELECT locus, xor(h, 8) AS h FROM s WHERE k = len(bs)"
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        inner = f"SELECT locus, xor(h, h >> {shift}) AS h FROM ({inner})"
        inner = f"SELECT locus, {times('h', factor)} AS h FROM ({inner})"
    return _with(*mixed, select=f"SELECT locus, xor(h, h >> 16) AS hash FROM ({inner})")


_BASKET = "basket AS (SELECT l_suppkey AS locus, l_partkey AS ind, CAST(least(count(*), 2) AS INTEGER) AS mac FROM lineitem GROUP BY ALL)"
_BASKET_FLIP = """flip AS (SELECT locus, 2 * count(*) FILTER (mac > 0) > (SELECT count(*) FROM part) - count(*) FILTER (mac < 0) AS flip FROM basket GROUP BY locus)"""
_BASKET_BITS = f"""SELECT locus, ind FROM (SELECT f.locus, p.p_partkey AS ind, f.flip, coalesce(b.mac, 0) AS mac FROM flip f CROSS JOIN part p
  LEFT JOIN basket b ON b.locus = f.locus AND b.ind = p.p_partkey) WHERE mac >= 0 AND (CASE WHEN mac = 0 THEN 0 WHEN mac % 2 = 1 THEN {_COIN} ELSE 1 END = 1) <> flip"""

ORACLES = {
    "scan_mac": _with(GENO, select="SELECT locus, ind, mac FROM geno"),
    "scan_bed": _with(GENO, select="SELECT locus, ind, mac FROM geno"),
    "scan_bim": "SELECT vec_id AS idx, concat('L', vec_id) AS name FROM embeddings",
    "flip_decision": _with(GENO, FLIP, select="SELECT locus, n_carrier, n_called, flip FROM flip"),
    "missing_mask": _with(GENO, select="SELECT locus, CAST(count(*) FILTER (mac < 0) AS INTEGER) AS n_missing FROM geno GROUP BY locus"),
    "het_resolve": _with(GENO, select=f"SELECT locus, ind, CAST({_COIN} AS INTEGER) AS bit FROM geno WHERE mac = 1"),
    "binarize_bits": _with(*GENO_BITS, select="SELECT locus, ind FROM bits"),
    "binarize_mac": _with(_BASKET, _BASKET_FLIP, select=_BASKET_BITS),
    "popcount": "SELECT p_partkey AS value, CAST(bit_count(p_partkey) AS INTEGER) AS n_bits FROM part",
    "popcount_locus": _with(*GENO_BITS, select="SELECT vec_id AS locus, CAST(count(ind) AS INTEGER) AS n_set FROM embeddings LEFT JOIN bits ON locus = vec_id GROUP BY vec_id"),
    "popcount_window": _with(
        *GENO_BITS, select="SELECT vec_id AS locus, CAST(count(ind) AS INTEGER) AS n_set FROM embeddings LEFT JOIN bits ON locus = vec_id AND ind BETWEEN 16 AND 47 GROUP BY vec_id"
    ),
    "oph_pad": _with(_pads(64, 10), select="SELECT pad_pos, src_ind FROM pads"),
    "oph_permute": _with(*GENO_BITS, *_places(64, 10), select="SELECT locus, CAST(pos AS INTEGER) AS pos FROM placed"),
    "oph_sketch": _with(*GENO_BITS, *_sketch(64, 16), select="SELECT locus, bin, v FROM sk"),
    "oph_densify": _with(*GENO_DENSE, select="SELECT locus, string_agg(CAST(v AS VARCHAR), ',' ORDER BY bin) AS sketch_txt FROM cells GROUP BY locus"),
    "oph_monomorphic": r"SELECT doc_id AS locus FROM documents WHERE regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', '', 'g') = ''",
    "jaccard_exact_pairs": _with(*GENO_BITS, EXACT, select="SELECT row, col, n_intersect, n_union FROM exact"),
    "jaccard_hash_pairs": _with(*GENO_DENSE, _equal(16, _ALL), select="SELECT row, col, n_eq FROM equal"),
    "quantize": _with(_COUNTED, select=f"SELECT i AS n_intersect, u AS n_union, {_q('i', 'u')} AS q, {_printed(_q('i', 'u'))} AS jaccard FROM counted"),
    "ld_exact": _with(*GENO_BITS, EXACT, select=f"SELECT row + 1 AS locus1, col + 1 AS locus2, {_printed(_q('n_intersect', 'n_union'))} AS jaccard FROM exact"),
    "ld_hash_all": _with(*GENO_DENSE, _equal(16, _ALL), select=_LISTED.format(k=16, cut=0.25)),
    "ld_with_names": _with(*GENO_BITS, EXACT, select=f"SELECT concat('L', row) AS name1, concat('L', col) AS name2, {_printed(_q('n_intersect', 'n_union'))} AS jaccard FROM exact"),
    "bands": _with(*TEXT_DENSE, select="SELECT locus, CAST(bin // 4 AS INTEGER) AS band, CAST(count(*) AS INTEGER) AS n_rows FROM cells GROUP BY locus, bin // 4"),
    "band_keys": _with(*TEXT_DENSE, KEYS, select="SELECT locus, band, key FROM keyed"),
    "buckets": _with(*GROUPED, select="SELECT band, key, first_locus, locus FROM keyed JOIN buckets USING (band, key)"),
    "buckets_dedup": _with(
        *GROUPED,
        "firsts AS (SELECT loci_txt, min((band, key)) AS least FROM buckets GROUP BY loci_txt)",
        select="SELECT band, key, first_locus, locus FROM keyed JOIN buckets USING (band, key) JOIN firsts USING (loci_txt) WHERE (band, key) = least",
    ),
    "ld_groups": _with(*GROUPED, select="SELECT first_locus, locus, n_pairs FROM members JOIN sizes USING (first_locus)"),
    "group_cum_pairs": _with(
        *GROUPED, select="SELECT row_number() OVER o AS group_id, n_pairs, CAST(sum(n_pairs) OVER o AS BIGINT) AS cum_pairs FROM sizes WINDOW o AS (ORDER BY first_locus)"
    ),
    "ld_groups_long": _with(
        *GROUPED,
        select="SELECT concat('G', g) AS groupID, locus + 1 AS locusIdx FROM members JOIN (SELECT first_locus, row_number() OVER (ORDER BY first_locus) AS g FROM sizes) USING (first_locus)",
    ),
    "group_pairs": _with(*GROUPED, _IN_GROUPS, select="SELECT x AS row, y AS col FROM pairs"),
    "ld_in_groups": _with(
        *GROUPED, _IN_GROUPS, _equal(64, "pairs JOIN cells a ON a.locus = x JOIN cells b ON b.locus = y AND b.bin = a.bin"), select=_LISTED.format(k=64, cut=0.5)
    ),
    "matrix_insert": _with(_COUNTED, select=_inserted("true")),
    "matrix_merge": _with(
        _COUNTED,
        f"a AS ({_inserted('line <= 3')})",
        f"b AS ({_inserted('line >= 3')})",
        select="""SELECT row, col, q, 'left' AS side FROM a UNION ALL SELECT row, col, q, 'left' FROM b ANTI JOIN a USING (row, col)
UNION ALL SELECT row, col, q, 'right' FROM b UNION ALL SELECT row, col, q, 'right' FROM a ANTI JOIN b USING (row, col)""",
    ),
    "matrix_append": _with(_COUNTED, select=f"{_inserted('line <= 3')} UNION ALL {_inserted('line >= 3')}"),
    "matrix_order": _with(_COUNTED, select=_inserted("true")),
    "matrix_stats": _with(_COUNTED, select=f"SELECT count(*) AS n_elements, count(*) * 8 AS n_bytes FROM ({_inserted('true')})"),
    "triangle_rank": _with(_COUNTED, select=f"SELECT row * (row - 1) // 2 + col AS vec_idx, row, col FROM ({_SORTED})"),
    "triangle_unrank": """SELECT o_orderkey AS vec_idx, CAST(r AS BIGINT) AS row, CAST(o_orderkey - r * (r - 1) // 2 AS BIGINT) AS col
FROM orders JOIN range(1, 20000) t(r) ON o_orderkey >= r * (r - 1) // 2 AND o_orderkey < r * (r + 1) // 2""",
    "chunk_sizes": "SELECT CAST(c AS BIGINT) AS chunk, CAST(35 // 4 + CASE WHEN c < 35 % 4 THEN 1 ELSE 0 END AS BIGINT) AS size FROM range(4) t(c)",
    "chunk_ranges": _with(
        TRIANGLE,
        "ch AS (SELECT c AS chunk, 9 * c AS a, least(9 * c + 9, 35) AS b FROM range(4) t(c))",
        select="SELECT CAST(chunk AS BIGINT) AS chunk, x.row AS row0, x.col AS col0, y.row AS row1, y.col AS col1 FROM ch JOIN tri x ON x.vec_idx = a JOIN tri y ON y.vec_idx = b",
    ),
    "group_ranges": """WITH g AS (SELECT CAST(g AS BIGINT) AS g, CAST(n * (n - 1) // 2 AS BIGINT) AS p, CAST(sum(n * (n - 1) // 2) OVER (ORDER BY g) AS BIGINT) AS c
  FROM (VALUES (1, 7), (2, 5), (3, 11)) t(g, n)),
z AS (SELECT least((SELECT c - p + 2 + 12 FROM g WHERE g = 2), (SELECT max(c) FROM g)) AS z)
SELECT g AS "group", CAST(p - (c - z) AS BIGINT) AS pair_count FROM g, z WHERE g >= 2 AND c >= z ORDER BY g LIMIT 1""",
    "murmur_u32": _murmur("value", 2153025618),
    "murmur_indexes": _murmur_list("list_transform(xs, lambda x: x & 65535)"),
    "murmur_vector": _murmur_list("list_append(list_transform(xs[:len(xs) - len(xs) % 2], lambda x: x & 65535), CASE WHEN len(xs) % 2 = 1 THEN xs[-1] & 255 ELSE 0 END)"),
    "murmur_window": _murmur_list("list_transform(list_filter(range(4, 13, 2), lambda i: i <= len(xs)), lambda i: xs[i] & 65535)"),
}
