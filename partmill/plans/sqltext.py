"""SQL text fragments (DuckDB) reused by the equivalents of several queries."""

from __future__ import annotations


def entity_key(c: str) -> str:
    x = f"regexp_replace(coalesce({c}, ''), '\\s*\\([^)]*\\)', ' ', 'g')"
    x = f"lower(replace({x}, '&', ' and '))"
    for word, short in (("incorporated", "inc"), ("corporation", "corp"), ("limited", "ltd"), ("company", "co")):
        x = f"regexp_replace({x}, '\\b{word}\\b', '{short}', 'g')"
    return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"


def lov_key(c: str) -> str:
    return f"trim(regexp_replace(lower(replace(coalesce({c}, ''), '-', ' ')), '\\s+', ' ', 'g'))"


def compact(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"


def display(c: str) -> str:
    x = f"translate({c}, '_-', '  ')"
    x = f"regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    x = f"regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def masks_cte(out: str, strings: str) -> str:
    """CTE `out`: (s, masks) for the query `strings` (s): a bit for each place of each character."""
    return f"""{out} AS (SELECT s, map_from_entries(list((ch, m))) AS masks FROM (
  SELECT s, ch, CAST(sum(CAST(1 AS BIGINT) << (i - 1)) AS BIGINT) AS m FROM (
    SELECT s, unnest(string_split(s, '')) AS ch, generate_subscripts(string_split(s, ''), 1) AS i FROM ({strings})) GROUP BY s, ch) GROUP BY s)"""


def lcs(a: str, masks: str, b: str) -> str:
    """Length of the longest common subsequence of a (up to 60 characters, with its masks) and b."""
    full = f"((CAST(1 AS BIGINT) << length({a})) - 1)"
    steps = f"[{full}] || list_transform(string_split({b}, ''), lambda ch_: coalesce({masks}[ch_], 0))"
    return f"(length({a}) - bit_count(list_reduce({steps}, lambda st_, bits_: ((st_ + (st_ & bits_)) | (st_ - (st_ & bits_))) & {full})))"


def token_order(c: str) -> str:
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def fuzzy_ctes(out: str, names: str, catalog: str) -> str:
    """CTEs ending in `out` (key, canonical, score): the best of `catalog` (canonical, k, position) for `names` (key), at least 80."""
    return f"""{out}_n AS (SELECT DISTINCT key, {token_order('key')} AS s FROM ({names}) WHERE key <> ''),
{masks_cte(out + '_m', f'SELECT DISTINCT s FROM {out}_n')},
{out}_c AS (SELECT DISTINCT canonical, k, position, {token_order('k')} AS t FROM ({catalog}) WHERE k <> ''),
{out}_s AS (SELECT n.key, c.canonical, c.position, 200.0e0 * {lcs('n.s', 'm.masks', 'c.t')} / (length(n.s) + length(c.t)) AS score
  FROM {out}_n n JOIN {out}_m m USING (s) JOIN {out}_c c ON levenshtein(n.s, c.t) <= 0.2 * (length(n.s) + length(c.t)) + 0.001),
{out} AS (SELECT key, canonical, score FROM {out}_s WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, canonical, position) = 1)"""


def set_ratio_ctes(out: str, left: str, right: str) -> str:
    """CTEs ending in `out` (s, t, sort_ratio, set_ratio): both token ratios of all pairs of `left` (s) and `right` (t)."""
    def words(c):
        return f"list_sort(list_distinct(string_split({c}, ' ')))"
    return f"""{out}_n AS (SELECT s, {token_order('s')} AS so, {words('s')} AS sw FROM ({left})), {out}_o AS (SELECT t, {token_order('t')} AS t_o, {words('t')} AS tw FROM ({right})),
{out}_p AS (SELECT *, list_filter(sw, lambda w_: NOT list_contains(tw, w_)) AS xs, list_filter(tw, lambda w_: NOT list_contains(sw, w_)) AS ys, list_filter(sw, lambda w_: list_contains(tw, w_)) AS cs FROM {out}_n, {out}_o),
{out}_l AS (SELECT *, array_to_string(xs, ' ') AS x, array_to_string(ys, ' ') AS y, length(array_to_string(cs, ' ')) AS c, CASE WHEN len(cs) > 0 THEN 1 ELSE 0 END AS gap FROM {out}_p),
{masks_cte(out + '_m', f"SELECT so AS s FROM {out}_n UNION SELECT x FROM {out}_l WHERE x <> ''")},
{out} AS (SELECT l.s, l.t, 200.0e0 * {lcs('so', 'ms.masks', 't_o')} / (length(so) + length(t_o)) AS sort_ratio,
  CASE WHEN gap = 1 AND (x = '' OR y = '') THEN 100.0e0 ELSE greatest(100 - 100.0e0 * (length(x) + length(y) - 2 * {lcs('x', 'mx.masks', 'y')}) / (2 * (c + gap) + length(x) + length(y)),
    CASE WHEN gap = 1 THEN 100 - 100.0e0 * (1 + length(x)) / (2 * c + 1 + length(x)) END, CASE WHEN gap = 1 THEN 100 - 100.0e0 * (1 + length(y)) / (2 * c + 1 + length(y)) END) END AS set_ratio
  FROM {out}_l l JOIN {out}_m ms ON ms.s = so LEFT JOIN {out}_m mx ON mx.s = x)"""


UNIT_VALUES = """('in','in'),('in.','in'),('inch','in'),('inches','in'),('"','in'),('ft','ft'),('ft.','ft'),('foot','ft'),('feet','ft'),('''','ft'),
('mm','mm'),('millimeter','mm'),('millimeters','mm'),('cm','cm'),('centimeter','cm'),('centimeters','cm'),('v','V'),('volt','V'),('volts','V'),('vac','V'),
('a','A'),('amp','A'),('amps','A'),('ampere','A'),('amperes','A'),('dba','dBA'),('db(a)','dBA'),('ea','EA'),('each','EA'),('pc','EA'),('pcs','EA'),
('piece','EA'),('pieces','EA'),('pk','PK'),('pack','PK'),('packs','PK')"""

_WORDS = ["centimeters", "millimeters", "centimeter", "millimeter", "amperes", "ampere", "inches", "pieces", "db(a)",
          "piece", "packs", "volts", "amps", "each", "feet", "foot", "inch", "pack", "volt", "amp", "dba", "ft.", "in.",
          "pcs", "vac", "cm", "ea", "ft", "in", "mm", "pc", "pk", "a", "v"]
ANY_UNIT = "|".join(w.replace("(", "\\(").replace(")", "\\)").replace(".", "\\.") for w in _WORDS)


def split_ctes(src: str, value: str, out: str) -> str:
    """CTE `out`: all columns of src plus _sv and _su."""
    t = f"nullif(trim({value}), '')"
    pat = f"^(.*\\d)[ .\\-]*({ANY_UNIT})$"
    return f"""{out} AS (SELECT *,
  CASE WHEN {t} LIKE '%"' THEN nullif(trim(left({t}, length({t}) - 1)), '')
       WHEN regexp_matches({t}, '^[ .\\-]*({ANY_UNIT})$', 'i') THEN NULL
       WHEN regexp_matches({t}, '{pat}', 'i') THEN regexp_extract({t}, '{pat}', 1, 'i') ELSE {t} END AS _sv,
  CASE WHEN {t} LIKE '%"' THEN '"'
       WHEN regexp_matches({t}, '^[ .\\-]*({ANY_UNIT})$', 'i') THEN regexp_extract({t}, '^[ .\\-]*({ANY_UNIT})$', 1, 'i')
       WHEN regexp_matches({t}, '{pat}', 'i') THEN regexp_extract({t}, '{pat}', 2, 'i') END AS _su FROM {src})"""


def fraction_ctes(src: str, value: str, out: str) -> str:
    """CTEs ending in `out`: all columns of src plus _fv and _fm (band join to the 64ths table)."""
    return f"""{out}_64 AS (SELECT k / 64.0e0 AS d, CAST(k // g AS STRING) || '/' || CAST(64 // g AS STRING) AS f FROM (SELECT k, gcd(k, 64) AS g FROM range(1, 64) r(k)) x),
{out}_n AS (SELECT *, row_number() OVER () AS _row, trim({value}) AS _t, CASE WHEN regexp_matches(trim({value}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST(trim({value}) AS DOUBLE) END AS _num FROM {src}),
{out}_f AS (SELECT _row, min(f) AS f FROM {out}_n JOIN {out}_64 ON abs(abs(_num) - trunc(abs(_num)) - d) <= 0.0005 GROUP BY _row),
{out} AS (SELECT n.* EXCLUDE (_row, _t, _num),
  CASE WHEN regexp_matches(_t, '^\\d+(\\s*-\\s*|\\s+)\\d+\\s*/\\s*\\d+$') THEN regexp_replace(replace(regexp_replace(_t, '^(\\d+)(?:\\s*-\\s*|\\s+)(\\d+)', '\\1-\\2'), ' ', ''), ' ', '')
       WHEN regexp_matches(_t, '^\\d+\\s*/\\s*\\d+$') THEN replace(_t, ' ', '')
       WHEN abs(_num - round(_num)) < 1e-9 THEN CAST(CAST(round(_num) AS BIGINT) AS STRING)
       WHEN f IS NOT NULL AND trunc(_num) = 0 THEN CASE WHEN _num < 0 THEN '-' ELSE '' END || f
       WHEN f IS NOT NULL THEN CAST(CAST(trunc(_num) AS BIGINT) AS STRING) || '-' || f ELSE _t END AS _fv,
  CASE WHEN regexp_matches(_t, '^\\d+(\\s*-\\s*|\\s+)\\d+\\s*/\\s*\\d+$') OR regexp_matches(_t, '^\\d+\\s*/\\s*\\d+$') THEN 'FRACTION'
       WHEN abs(_num - round(_num)) < 1e-9 THEN NULL WHEN f IS NOT NULL THEN 'FRACTION' END AS _fm
  FROM {out}_n n LEFT JOIN {out}_f USING (_row))"""


COUNT_WORDS = "('pc', 'pcs', 'piece', 'pieces', 'pk', 'pack', 'packs', 'ea', 'each')"


def title_rows(src: str, key: str = "product_id", text: str = "description") -> str:
    """SELECT of (key, label, value, uom, evidence_text) read from the tokens of titles: ks kinds, ts texts, ats places among parts ps."""
    def amount(i):
        return (f"CASE WHEN coalesce(ks[{i}], '') <> 'n' THEN 0 WHEN ks[{i} + 1] = 'n' AND ks[{i} + 2] = '/' AND ks[{i} + 3] = 'n' THEN 4 "
                f"WHEN ks[{i} + 1] = '/' AND ks[{i} + 2] = 'n' THEN 3 WHEN ks[{i} + 1] = '.' AND ks[{i} + 2] = 'n' AND ats[{i} + 2] = ats[{i}] + 2 THEN 3 ELSE 1 END")
    def value(i, n):
        return f"CASE WHEN {n} = 4 THEN ts[{i}] || '-' || ts[{i} + 1] || '/' || ts[{i} + 3] ELSE array_to_string(ts[{i}:{i} + {n} - 1], '') END"
    def written(i, j):
        return f"array_to_string(ps[ats[{i}]:ats[{j}]], '')"
    parts = f"""SELECT {key}, ps, unnest(ps) AS t, generate_subscripts(ps, 1) AS pl FROM (SELECT {key}, regexp_extract_all({text}, '[ ]+|[0-9]+|[A-Za-z]+|.') AS ps FROM {src})"""
    kinds = f"""SELECT *, CASE WHEN regexp_matches(t, '^[0-9]') THEN 'n' WHEN t = '"' OR lower(t) IN ('in', 'inch', 'inches') THEN 'u' WHEN lower(t) = 'x' THEN 'x'
      WHEN lower(t) IN {COUNT_WORDS} THEN 'q' WHEN regexp_matches(t, '^[A-Za-z]') THEN 'w' ELSE t END AS k FROM ({parts}) WHERE trim(t) <> ''"""
    lists = f"SELECT {key}, any_value(ps) AS ps, list(k ORDER BY pl) AS ks, list(t ORDER BY pl) AS ts, list(pl ORDER BY pl) AS ats FROM ({kinds}) GROUP BY {key}"
    starts = f"SELECT *, {amount('i')} AS a FROM (SELECT *, unnest(generate_series(1, len(ks))) AS i FROM ({lists}))"
    sizes = f"SELECT *, i + a + 2 AS j, {amount('(i + a + 2)')} AS b FROM ({starts}) WHERE a > 0 AND ks[i + a] = 'u' AND ks[i + a + 1] = 'x'"
    sizes = f"SELECT *, CASE WHEN ks[j + b] = 'u' THEN ts[j + b] END AS lu FROM ({sizes}) WHERE b > 0 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i) = 1"
    shown = written("i", "j + b - CASE WHEN lu IS NULL THEN 1 ELSE 0 END")
    packs = f"""SELECT * FROM ({starts}) WHERE ks[i] = 'n' AND ks[i + 1] = 'q' AND NOT coalesce(ats[i + 2] = ats[i + 1] + 1 AND regexp_matches(ts[i + 2], '^[A-Za-z0-9_]'), false)
      QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i) = 1"""
    return f"""SELECT {key}, 'Width' AS label, {value('i', 'a')} AS value, ts[i + a] AS uom, {shown} AS evidence_text FROM ({sizes})
UNION ALL SELECT {key}, 'Length', {value('j', 'b')}, coalesce(lu, ts[i + a]), {shown} FROM ({sizes})
UNION ALL SELECT {key}, 'Quantity', replace({written('i', 'i + 1')}, ' ', ''), NULL, {written('i', 'i + 1')} FROM ({packs})"""


def normalize_ctes(src: str, out: str, value: str = "value", uom: str = "uom", vocab: str | None = None) -> str:
    """CTEs ending in `out`: src columns plus raw_value, raw_uom, normalized_value, normalized_uom, method.

    `vocab` names a table (label, classpath, key, canonical) with folded spellings."""
    lov = (f"LEFT JOIN {vocab} v ON v.label = f.label AND v.classpath = coalesce(f.classpath, '') AND v.key = {lov_key('f._tx')}"
           if vocab else "LEFT JOIN (SELECT NULL AS canonical) v ON false")
    return f"""{out}_a AS (SELECT *, nullif(trim({value}), '') AS _rv, nullif(trim({uom}), '') AS _ru FROM {src}),
{split_ctes(out + '_a', '_rv', out + '_b')},
{out}_c AS (SELECT *, coalesce(_sv, _rv) AS _w, coalesce(_ru, _su) AS _wu FROM {out}_b),
{fraction_ctes(out + '_c', '_w', out + '_d')},
{out}_u(alias, code) AS (VALUES {UNIT_VALUES}),
{out}_e AS (SELECT d.*, CASE WHEN _fm IS NOT NULL THEN _fv ELSE _w END AS _tx, u.code AS _cu, s.code AS _cs FROM {out}_d d
  LEFT JOIN {out}_u u ON u.alias = lower(trim(_wu)) LEFT JOIN {out}_u s ON s.alias = lower(trim(_su))),
{out} AS (SELECT f.* EXCLUDE (_rv, _ru, _sv, _su, _w, _wu, _fv, _fm, _tx, _cu, _cs), _rv AS raw_value, CASE WHEN _rv IS NULL THEN _ru ELSE coalesce(_ru, _su) END AS raw_uom,
  CASE WHEN _rv IS NOT NULL THEN coalesce(v.canonical, CASE WHEN regexp_matches(_tx, '\\s\\s') THEN trim(regexp_replace(_tx, '\\s+', ' ', 'g')) END, _tx) END AS normalized_value, _cu AS normalized_uom,
  CASE WHEN _rv IS NOT NULL THEN nullif(concat_ws('+', CASE WHEN (_sv IS NOT NULL AND _sv <> _rv) OR (_su IS NOT NULL AND _ru IS NULL) THEN 'VALUE_UOM_SPLIT' END, _fm,
    CASE WHEN v.canonical IS NOT NULL THEN 'LOV' WHEN regexp_matches(_tx, '\\s\\s') THEN 'STRING' END,
    CASE WHEN _cu IS NOT NULL AND (_cu <> _wu OR (_su IS NOT NULL AND coalesce(_cs = _cu, false) AND (_ru IS NULL OR _cs <> _su))) THEN 'UOM_STANDARD' END), '') END AS method
  FROM {out}_e f {lov})"""


def appears(v: str, t: str) -> str:
    r, low = f"lower(trim({v}))", f"lower({t})"
    forms = [r, f"replace({r}, ' in', '\"')", f"replace({r}, '\"', ' in')", f"replace({r}, 'inch', 'in')", f"replace({r}, ' ', '')"]
    some = " OR ".join(f"({f} <> '' AND contains({low}, {f}))" for f in forms)
    small = f"regexp_replace({r}, '[^a-z0-9]', '', 'g')"
    return (f"(coalesce({r}, '') <> '' AND ({some} OR (length({small}) >= 2 AND contains("
            f"regexp_replace({low}, '[^a-z0-9]', '', 'g'), {small}))))")
