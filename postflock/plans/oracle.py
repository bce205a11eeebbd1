"""The same queries in DuckDB's SQL, written on their own."""

from __future__ import annotations

from . import fixtures as X
from ..functions.hashing import M32, M64, SEED32, SEED64, SHIFT32, SHIFT64
from ..functions.stem import FOURTH, SECOND, THIRD
from .queries import FLAGGED, LEAST_CF, LEAST_POSTS, LISTED, MATRIX, OTHERS, SCORED, SEED, SELECT, TOP, TOTAL, USER

HERE = {"events": "events", "documents": "documents"}
URL = "(starts_with({0}, 'http://') OR instr({0}, '.com') > 1 OR instr({0}, '.gov') > 1 OR instr({0}, '.org') > 1 OR instr({0}, '.net') > 1 OR instr({0}, '.edu') > 1 OR instr({0}, '.cn') > 1)"
NAME = "lower(regexp_replace(substr({0}, 2), ':$', ''))"
MARK = "{0} IN ('RT', 'RT:')"

BASE = f"""
posts AS ({X.POSTS.format(**HERE)}),
users AS ({X.USERS.format(**HERE)}),
scores AS ({X.SCORES.format(**HERE)}),
clusters AS ({X.CLUSTERS.format(**HERE)}),
toks AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS t FROM posts),
tok AS (SELECT ts, user_name, unnest(t) AS k, generate_subscripts(t, 1) AS pos FROM toks),
mark AS (SELECT ts, pos, pos - row_number() OVER (PARTITION BY ts ORDER BY pos) AS run FROM tok WHERE {MARK.format("k")}),
-- in a run of markers each second one is used up by the one before it
live AS (SELECT ts, pos FROM (SELECT *, min(pos) OVER (PARTITION BY ts, run) AS start FROM mark) WHERE (pos - start) % 2 = 0),
first_mark AS (SELECT ts, min(pos) AS pos FROM mark GROUP BY ts),
mention AS (SELECT k.ts, k.user_name AS src, {NAME.format("k.k")} AS dst FROM tok k LEFT JOIN first_mark m ON k.ts = m.ts
            WHERE starts_with(k.k, '@') AND (m.pos IS NULL OR k.pos < m.pos)),
named AS (SELECT l.ts, l.pos, k.user_name, k.k FROM live l JOIN tok k ON k.ts = l.ts AND k.pos = l.pos + 1 WHERE starts_with(k.k, '@')),
retweet AS (SELECT src, dst FROM (SELECT user_name AS src, {NAME.format("k")} AS dst, row_number() OVER (PARTITION BY ts ORDER BY pos) AS i FROM named) WHERE i = 1 AND dst <> '')
"""


def _pattern(x):
    return f"list_reduce(regexp_extract_all({x}, '.'), lambda a, c: a || CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND ends_with(a, 'C')) THEN 'V' ELSE 'C' END, '')"


def _cut(x, n):
    return f"substr({x}, 1, length({x}) - {n})"


def _m(x):
    return f"len(regexp_extract_all({_pattern(x)}, 'VC'))"


STEMS = f"""
low AS (SELECT ts, user_name, pos, k, lower(k) AS l FROM tok JOIN (SELECT ts FROM toks WHERE len(t) >= 3) USING (ts) WHERE NOT starts_with(k, '@')),
word AS (SELECT ts, user_name, pos, regexp_replace(l, '[^a-z]', '', 'g') AS w FROM low WHERE NOT starts_with(k, '#') AND NOT {URL.format("l")}),
tag AS (SELECT ts, user_name, pos, CASE WHEN regexp_matches(right(l, 1), '[a-zA-Z0-9]') THEN l WHEN length(l) > 2 THEN {_cut("l", 1)} END AS term FROM low WHERE starts_with(k, '#') AND length(k) > 1),
w0 AS (SELECT DISTINCT w FROM word WHERE w <> ''),
w1 AS (SELECT w, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut("w", 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut("w", 1)} ELSE w END AS a FROM w0),
w2 AS (SELECT w, a, CASE WHEN ends_with(a, 'eed') THEN NULL WHEN ends_with(a, 'ed') AND contains({_pattern(_cut("a", 2))}, 'V') THEN {_cut("a", 2)}
                         WHEN ends_with(a, 'ing') AND contains({_pattern(_cut("a", 3))}, 'V') THEN {_cut("a", 3)} END AS b FROM w1),
stems AS (SELECT w, CASE WHEN length(w) < 3 THEN w
   WHEN ends_with(a, 'eed') THEN CASE WHEN {_m(_cut("a", 3))} > 0 THEN {_cut("a", 1)} ELSE a END
   WHEN b IS NULL THEN a
   WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
   WHEN length(b) > 1 AND right(b, 1) = substr(b, length(b) - 1, 1) AND ends_with({_pattern("b")}, 'C') THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE {_cut("b", 1)} END
   WHEN {_m("b")} = 1 AND ends_with({_pattern("b")}, 'CVC') AND right(b, 1) NOT IN ('w', 'x', 'y') THEN b || 'e'
   ELSE b END AS s FROM w2),
terms AS (SELECT ts, user_name, pos, s AS term FROM word JOIN stems USING (w) WHERE length(s) >= 3 UNION ALL SELECT * FROM tag WHERE term IS NOT NULL),
dict AS (SELECT term, CAST(count(*) AS BIGINT) AS cf FROM terms WHERE starts_with(term, '#') OR term NOT IN ({", ".join(f"'{x}'" for x in X.STOPWORDS)}) GROUP BY term HAVING count(*) >= {LEAST_CF} OR starts_with(term, '#'))
"""


def _sql(body: str, *more: str) -> str:
    return "WITH " + ",".join([BASE, *more]) + body


def _graph(kind: str) -> str:
    return f"""
raw AS (SELECT src, dst FROM {kind}),
kept AS (SELECT src, dst FROM raw WHERE src <> dst AND src IN (FROM users) AND dst IN (FROM users)),
e AS (SELECT DISTINCT src, dst FROM kept),
anyone AS (SELECT DISTINCT user_name FROM (SELECT src AS user_name FROM raw UNION ALL SELECT dst FROM raw) WHERE user_name IN (FROM users)),
deg AS (SELECT user_name,
   (SELECT count(*) FROM e WHERE src = user_name AND EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src)) AS d,
   (SELECT count(*) FROM e WHERE src = user_name) AS o, (SELECT count(*) FROM e WHERE dst = user_name) AS i,
   (SELECT count(*) FROM kept WHERE src = user_name) AS ts, (SELECT count(*) FROM kept WHERE dst = user_name) AS ti FROM anyone),
outs AS (SELECT u.user_name, list_sort(coalesce(list(e.dst) FILTER (e.dst IS NOT NULL), [])) AS nbrs FROM (SELECT DISTINCT src AS user_name FROM raw WHERE src IN (FROM users)) u LEFT JOIN e ON e.src = u.user_name GROUP BY 1),
ins AS (SELECT u.user_name, list_sort(coalesce(list(e.src) FILTER (e.src IS NOT NULL), [])) AS nbrs FROM (SELECT DISTINCT dst AS user_name FROM raw WHERE dst IN (FROM users)) u LEFT JOIN e ON e.dst = u.user_name GROUP BY 1)
"""


def _near(side: str, name: str, key: str, other: str) -> str:
    parts = []
    for col, degree in (("o", "out"), ("i", "in")):
        n, s, q = "count(*)", f"sum({col})", f"sum({col} * {col})"
        parts.append(f"CAST({s} AS DOUBLE) / {n} AS {name}_{degree}_mean, CAST({n} * {q} - {s} * {s} AS DOUBLE) / CAST({n} * {n} AS DOUBLE) AS {name}_{degree}_var")
    return f"{side} AS (SELECT e.{key} AS user_name, {', '.join(parts)} FROM e JOIN deg ON deg.user_name = e.{other} GROUP BY 1)"


def _ego(adjacency: str, mirror: bool, name: str = "") -> str:
    src, dst = ("d", "s") if mirror else ("s", "d")
    stats = []
    for end, col in (("src", src), ("dst", dst)):
        stats.append(f"g_{end} AS (SELECT c, count(*) AS n, sum(k) AS s1, sum(k * k) AS s2 FROM (SELECT c, {col}, count(*) AS k FROM net GROUP BY c, {col}) GROUP BY c)")
    out = ", ".join(f"CAST({e}.n AS BIGINT) AS n_{e[2:]}, CAST({e}.s1 AS DOUBLE) / {e}.n AS {e[2:]}_mean, CAST({e}.n * {e}.s2 - {e}.s1 * {e}.s1 AS DOUBLE) / CAST({e}.n * {e}.n AS DOUBLE) AS {e[2:]}_var" for e in ("g_src", "g_dst"))
    result = f"\nSELECT g_src.c AS user_name, {out} FROM g_src JOIN g_dst USING (c)"
    return f"""
adj AS (SELECT user_name AS s, unnest(nbrs) AS d FROM {adjacency}),
own AS (SELECT user_name FROM {adjacency}),
star AS (SELECT s AS c, s, d FROM adj WHERE d IN (FROM own)),
net AS (SELECT * FROM star UNION ALL
        SELECT star.c, a.s, a.d FROM star JOIN adj a ON a.s = star.d AND a.d = star.c UNION ALL
        SELECT star.c, a.s, a.d FROM star JOIN adj a ON a.s = star.d AND a.d <> star.c AND a.d <> a.s JOIN adj b ON b.s = star.c AND b.d = a.d),
{", ".join(stats)}""" + (f", {name} AS ({result})" if name else result)


def _feature(name: str) -> str:
    values = {
        "word": "len(t)",
        "char": "length(text)",
        "hashtag": "len(list_filter(t, lambda x: starts_with(x, '#') AND length(x) > 1))",
        "url": f"len(list_filter(t, lambda x: {URL.format('x')}))",
        "mention_sent": "(SELECT count(*) FROM mention m WHERE m.ts = toks.ts)",
        "retweet_sent": f"CAST(len(list_filter(t, lambda x: {MARK.format('x')})) > 0 AS INT)",
        "original": f"CAST(len(list_filter(t, lambda x: {MARK.format('x')})) = 0 AS INT)",
    }
    return values[name]


COUNTED = {"word": True, "char": True, "hashtag": False, "url": False, "mention_sent": False}
FLAGS = ["retweet_sent", "original"]


def _stats(names: list[str], where: str = "") -> str:
    """A CTE f of the statistics."""
    out = []
    for x in names:
        n, s, q = "count(*)", f"sum({x})", f"sum({x} * {x})"
        if x in COUNTED:
            out += [f"CAST({s} AS BIGINT) AS {x}_sum", f"CAST({s} AS DOUBLE) / {n} AS {x}_avg"]
            if COUNTED[x]:
                out.append(f"CAST({n} * {q} - {s} * {s} AS DOUBLE) / CAST({n} * {n} AS DOUBLE) AS {x}_var")
        else:
            out += [f"CAST({s} AS BIGINT) AS {x}_count", f"CAST({s} AS DOUBLE) / {n} AS {x}_ratio"]
    values = ", ".join(f"CAST({_feature(x)} AS BIGINT) AS {x}" for x in names)
    return f"f AS (SELECT user_name, {', '.join(out)} FROM (SELECT user_name, {values} FROM toks {where}) GROUP BY user_name)"


ALL = [*COUNTED, *FLAGS]
WHOLE = [c for x in ALL for c in ((f"{x}_sum", f"{x}_avg", *([f"{x}_var"] if COUNTED[x] else [])) if x in COUNTED else (f"{x}_count", f"{x}_ratio"))]
COMPLETED = [_stats(ALL, "WHERE user_name IN (FROM users) AND contains(text, 'RT RT')"), f"done AS (SELECT row_number() OVER (ORDER BY users.user_name) AS local_id, users.user_name, {', '.join(f'coalesce({c}, 0) AS {c}' for c in WHOLE)} FROM users LEFT JOIN f USING (user_name))"]
TERMS = "(SELECT ts, user_name, string_agg(term, ' ' ORDER BY pos) AS text FROM {0} GROUP BY ts, user_name)"
ROUNDED = """cells AS (SELECT label AS cluster_id, CAST(generate_subscripts(embedding, 1) AS INT) AS col, floor(CAST(unnest(embedding) AS DOUBLE) * 1000) AS v FROM embeddings),
stats AS (SELECT cluster_id, col, CAST(count(*) AS BIGINT) AS n, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(var_pop(v), 4) AS var FROM cells GROUP BY cluster_id, col)"""
CHOSEN_USERS = f"listed AS (SELECT user_name, global_id AS place FROM users JOIN scores USING (user_name) WHERE n_events >= {LISTED})"
_report = [(0, "descriptive", 1), (0, "descriptive", 3), (0, "discriminating", 2), (0, "discriminating", 12), (1, "descriptive", 64), (1, "discriminating", 1)]
CHOSEN = f"chosen AS (SELECT * FROM (VALUES {', '.join(map(str, _report))}) v(cluster_id, kind, col))"



def _java(c: str) -> str:
    """A number as the reference prints it: whole ones plain, doubles with an
    exponent below a thousandth."""
    if not c.endswith(("_avg", "_var", "_ratio", "r")):
        return c
    s = f"CAST({c} AS VARCHAR)"
    small = f"regexp_replace(regexp_replace({s}, '^0\\.000([1-9])(\\d*)$', '\\1.\\2E-4'), '\\.E', '.0E')"
    tiny = f"regexp_replace(upper(CASE WHEN contains({s}, '.') THEN {s} ELSE replace({s}, 'e', '.0e') END), 'E-0', 'E-')"
    return f"CASE WHEN {c} = 0 OR {c} >= 1e-3 THEN {s} WHEN {c} >= 1e-4 THEN {small} ELSE {tiny} END"


def _murmur(text: str, size: int, m: int, shift: int, seed: int) -> str:
    """MurmurHash 2 of ASCII letters: words of ``size`` bytes folded in, then the rest."""
    kind, signed = ("UBIGINT", "BIGINT") if size == 8 else ("UINTEGER", "INTEGER")
    top = 1 << 8 * size
    times = lambda a: f"CAST((CAST({a} AS UHUGEINT) * {m}::UHUGEINT) % {top}::UHUGEINT AS {kind})"
    down = lambda a, n: f"xor({a}, {a} >> {n})"
    word = lambda at, n: "CAST('0x' || " + " || ".join(f"hex(substr({text}, {at} + {i}, 1))" for i in range(n - 1, -1, -1)) + f" AS {kind})"
    words = f"list_transform(range(0, len({text}) // {size}), lambda i: {word(f'CAST(i * {size} + 1 AS INT)', size)})"
    mixed = f"list_transform({words}, lambda k: {times(down(times('k'), shift))})"
    begin = f"xor(CAST({seed} AS {kind}), {times(f'len({text})')})" if size == 8 else f"xor(CAST({seed} AS {kind}), CAST(len({text}) AS {kind}))"
    fold = times("xor(h, k)") if size == 8 else f"xor({times('h')}, k)"
    whole = f"list_reduce(list_concat([{begin}], {mixed}), lambda h, k: {fold})"
    tails = " ".join(f"WHEN {n} THEN {times(f'xor(z, {word(f'(len({text}) // {size}) * {size} + 1', n)})')}" for n in range(1, size))
    first, last = (shift, shift) if size == 8 else (13, 15)
    end = f"list_transform(list_transform(list_transform([{whole}], lambda z: CASE len({text}) % {size} WHEN 0 THEN z {tails} END), lambda z: {times(down('z', first))}), lambda z: {down('z', last)})[1]"
    return f"CAST(CASE WHEN {end} >= {top // 2} THEN CAST({end} AS HUGEINT) - {top} ELSE {end} END AS {signed})"


def _porter() -> str:
    """Steps two to six of Porter's algorithm over the CTE stems, which is step one."""
    def table(x: str, rules) -> str:
        return "CASE WHEN length({0}) < 2 THEN {0} ".format(x) + " ".join(f"WHEN ends_with({x}, '{a}') THEN CASE WHEN {_m(_cut(x, len(a)))} > 0 THEN {_cut(x, len(a))} || '{b}' ELSE {x} END" for a, b in rules) + f" ELSE {x} END"

    # what is left keeps the s or t before -ion
    kept = lambda x, a: _cut(x, len(a) - (a in ("sion", "tion")))
    fourth = "CASE WHEN length(c) < 2 THEN c " + " ".join(f"WHEN ends_with(c, '{a}') THEN CASE WHEN {_m(kept('c', a))} > 1 THEN {kept('c', a)} ELSE c END" for a in FOURTH) + " ELSE c END"
    stop = f"ends_with({_pattern(_cut('d', 1))}, 'CVC') AND right({_cut('d', 1)}, 1) NOT IN ('w', 'x', 'y')"
    return f"""
p1 AS (SELECT w, CASE WHEN ends_with(s, 'y') AND contains({_pattern(_cut("s", 1))}, 'V') THEN {_cut("s", 1)} || 'i' ELSE s END AS a FROM stems WHERE length(w) >= 3),
p2 AS (SELECT w, {table("a", SECOND)} AS b FROM p1),
p3 AS (SELECT w, {table("b", THIRD)} AS c FROM p2),
p4 AS (SELECT w, {fourth} AS d FROM p3),
p5 AS (SELECT w, CASE WHEN ends_with(d, 'e') AND ({_m(_cut("d", 1))} > 1 OR {_m(_cut("d", 1))} = 1 AND NOT ({stop})) THEN {_cut("d", 1)} ELSE d END AS e FROM p4),
p6 AS (SELECT w, CASE WHEN ends_with(e, 'll') AND {_m("e")} > 1 THEN {_cut("e", 1)} ELSE e END AS f FROM p5)
"""


ORACLE_SQL = {
    "tweet_filter": _sql(f"SELECT * FROM {TERMS.format('(SELECT * FROM terms WHERE starts_with(term, $$#$$) OR term IN (SELECT term FROM dict))')}", STEMS),
    "tweet_filter_nodict": _sql(f"SELECT * FROM {TERMS.format('terms')}", STEMS),
    "tweet_dict": _sql("SELECT * FROM dict ORDER BY cf DESC, term", STEMS),
    "dict_sort": _sql("SELECT term, CAST(count(*) AS BIGINT) AS cf FROM terms GROUP BY term ORDER BY cf DESC, term", STEMS),
    "stem": _sql("SELECT w AS word, s AS stem FROM stems", STEMS),
    "porter_full": _sql("SELECT w AS word, f AS stem FROM p6 UNION ALL SELECT w, w FROM stems WHERE length(w) < 3", STEMS, _porter()),
    "murmur64": _sql(f"SELECT w AS word, {_murmur('w', 8, M64, SHIFT64, SEED64)} AS hash FROM w0", STEMS),
    "murmur32": _sql(f"SELECT w AS word, {_murmur('w', 4, M32, SHIFT32, SEED32)} AS hash FROM w0", STEMS),
    "export_random": _sql("SELECT concat_ws(' ', '1', " + ", ".join(f"'x{i}:' || {_java(f'r{i}.r')}" for i in range(1, 5)) + ", '#', user_name) AS line FROM (SELECT user_name, " + ", ".join(f"{{'r': CAST('0x' || substr(md5(user_name || '#{i}#{SEED}'), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE}} AS r{i}" for i in range(1, 5)) + " FROM users)"),
    "count_user_text": _sql(f"SELECT user_name, CAST(count(*) AS BIGINT) AS n_posts FROM posts GROUP BY 1 HAVING count(*) >= {LEAST_POSTS}"),
    "sort_posts": _sql("SELECT * FROM posts ORDER BY user_name, ts"),
    "count_user": _sql(f"SELECT user_name, CAST(count(*) AS BIGINT) AS n_posts FROM posts GROUP BY 1 HAVING count(*) >= {LEAST_POSTS}"),
    "filter_less_user": _sql(f"SELECT ts, user_name, text FROM posts WHERE user_name IN (SELECT user_name FROM posts GROUP BY 1 HAVING count(*) >= {LEAST_POSTS})"),
    "sample_by_user": _sql("SELECT ts, user_name, text FROM posts WHERE user_name IN (FROM users)"),
    "sample_random": _sql(f"SELECT * FROM posts WHERE CAST('0x' || substr(md5(user_name || '#{SEED}'), 1, 10) AS BIGINT) < {int(SELECT / TOTAL * (1 << 40))}"),
    "merge_posts": _sql("SELECT user_name, string_agg(text, ' ' ORDER BY ts, text) || ' ' AS text FROM posts GROUP BY 1"),
    "merge_posts_by_user": _sql("SELECT user_name, string_agg(text, ' ' ORDER BY ts, text) || ' ' AS text FROM posts WHERE user_name IN (FROM users) GROUP BY 1"),
    "relevant_user": _sql(f"SELECT ts, user_name, text FROM posts WHERE user_name = '{USER.strip().lower()}' OR ts IN (SELECT ts FROM tok WHERE starts_with(k, '@') AND {NAME.format('k')} = '{USER.strip().lower()}') ORDER BY user_name, ts"),
    "text_features": _sql("SELECT * FROM f", _stats(ALL)),
    "retweet_num_per_tweet": _sql(
        """, last_live AS (SELECT ts, max(pos) AS pos FROM live GROUP BY ts),
last_user AS (SELECT ts, arg_max(regexp_replace(substr(k, 2), ':$', ''), pos) AS u FROM named GROUP BY ts),
part AS (SELECT k.ts, string_agg(k.k, ' ' ORDER BY k.pos) AS part FROM tok k JOIN last_live l USING (ts)
         WHERE k.pos > l.pos + 1 OR (k.pos = l.pos + 1 AND NOT starts_with(k.k, '@') AND NOT k.k IN ('RT', 'RT:')) GROUP BY 1),
x AS (SELECT lower(u) AS user_name, part, substr(regexp_replace(lower(part), '[^a-z]', '', 'g'), 1, 35) AS letters FROM part JOIN last_user USING (ts) JOIN posts USING (ts)
      WHERE u <> '' AND length(part) >= 3 AND posts.user_name IN (FROM users))
SELECT user_name, letters, """ + _murmur("letters", 8, M64, SHIFT64, SEED64) + """ AS hash, CAST(count(*) AS BIGINT) AS n, max(part) AS sample FROM x WHERE user_name IN (FROM users) GROUP BY 1, 2"""
    ),
    "egonet_dump": _sql(
        """, l AS (SELECT user_name, nbrs, CASE WHEN len(nbrs) = 0 THEN user_name || chr(9) || '0' ELSE user_name || chr(9) || len(nbrs) || chr(9) || array_to_string(nbrs, chr(9)) END AS line FROM outs),
a AS (SELECT user_name AS node, 0 AS tag, line FROM l UNION ALL SELECT unnest(nbrs), 1, line FROM l)
SELECT node, CAST(tag AS BIGINT) AS tag, CAST(row_number() OVER (PARTITION BY node ORDER BY tag, line) AS BIGINT) AS place, tag || ' ' || line AS line FROM a""",
        _graph("mention"),
    ),
    "feature_sort": _sql("SELECT * FROM f ORDER BY user_name", _stats(["word"])),
    "feature_complete": _sql("SELECT * FROM done", *COMPLETED),
    "feature_normalize": _sql(
        f"SELECT local_id, user_name, global_id, {', '.join(f'CASE WHEN max({c}) OVER () > 0 THEN CAST({c} AS DOUBLE) / max({c}) OVER () ELSE 0 END AS {c}' for c in FLAGGED)}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in OTHERS)} FROM done JOIN scores USING (user_name)",
        *COMPLETED,
    ),
    "export_cluster": _sql(f"SELECT CAST(-1 AS BIGINT) AS place, '100 {len(MATRIX)}' AS line UNION ALL SELECT place, concat_ws(' ', {', '.join(map(_java, MATRIX))}) FROM done JOIN listed USING (user_name)", *COMPLETED, CHOSEN_USERS),
    "export_lda": _sql("SELECT CAST(place AS BIGINT) AS place, concat_ws(' ', '1', " + ", ".join(f"'f{i}:' || {_java(c)}" for i, c in enumerate(MATRIX, 1)) + ", '#', user_name) AS line FROM done JOIN listed USING (user_name)", *COMPLETED, CHOSEN_USERS),
    "local_user_map": _sql(f"SELECT u.user_name, s.global_id FROM users u LEFT JOIN (SELECT * FROM scores WHERE n_events >= {SCORED}) s USING (user_name)"),
    "local_user_pr": _sql(f"SELECT u.user_name, s.pr FROM users u LEFT JOIN (SELECT * FROM scores WHERE n_events >= {SCORED}) s USING (user_name)"),
    "cluster_feature_stat": f"WITH {ROUNDED} SELECT * FROM stats",
    "cluster_select_parse": f"WITH {CHOSEN} SELECT * FROM chosen",
    "cluster_selected_stat": f"WITH {ROUNDED}, {CHOSEN} SELECT stats.* FROM stats SEMI JOIN (SELECT * FROM chosen WHERE kind = 'descriptive') USING (cluster_id, col)",
    "cluster_top_users": _sql(f"SELECT * FROM (SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY pr DESC, user_name) AS BIGINT) AS place, user_name, pr FROM scores JOIN clusters USING (user_name)) WHERE place <= {TOP}"),
}
for _name in ALL:
    _key = {"original": "original_stat"}.get(_name, f"{_name}_stat")
    ORACLE_SQL[_key] = _sql("SELECT * FROM f", _stats([_name]))
for _kind in ("mention", "retweet"):
    _g = _graph(_kind)
    _link = "SELECT user_name, d AS uniq_double, o AS uniq_out, CASE WHEN o > 0 THEN CAST(d AS DOUBLE) / o ELSE 0 END AS double_out, i AS uniq_in, CASE WHEN i > 0 THEN CAST(d AS DOUBLE) / i ELSE 0 END AS double_in, ts AS total_out, ti AS total_in FROM deg"
    _cols = [f"{s}_{d}_{m}" for s in ("out", "in") for d in ("out", "in") for m in ("mean", "var")]
    _subnet = f"SELECT user_name, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _cols)} FROM anyone LEFT JOIN so USING (user_name) LEFT JOIN si USING (user_name)"
    ORACLE_SQL |= {
        f"{_kind}_outlink": _sql("SELECT user_name, CAST(len(nbrs) AS BIGINT) AS n, array_to_string(nbrs, ' ') AS nbrs FROM outs", _g),
        f"{_kind}_inlink": _sql("SELECT user_name, CAST(len(nbrs) AS BIGINT) AS n, array_to_string(nbrs, ' ') AS nbrs FROM ins", _g),
        f"{_kind}_link_stat": _sql(_link, _g),
        f"{_kind}_subnet": _sql(_subnet, _g, _near("so", "out", "src", "dst"), _near("si", "in", "dst", "src")),
        f"{_kind}_out_egonet": _sql("," + _ego("outs", False), _g),
        f"{_kind}_in_egonet": _sql("," + _ego("ins", True), _g),
    }


def _side(kind: str) -> str:
    """What feature_wide has of a graph, by user."""
    graph = _graph(kind)
    near = [_near("so", "out", "src", "dst"), _near("si", "in", "dst", "src")]
    return f"(WITH {','.join([graph, *near])}, links AS ({_link}), around AS ({_subnet}), {_ego('outs', False, 'ego')} SELECT anyone.user_name AS u, {', '.join(f'{c} AS {kind}_{c}' for c in _link_names + _cols + _ego_names)} FROM anyone LEFT JOIN links USING (user_name) LEFT JOIN around USING (user_name) LEFT JOIN ego USING (user_name))"


_link_names = ["uniq_double", "uniq_out", "double_out", "uniq_in", "double_in", "total_out", "total_in"]
_ego_names = [f"{e}{x}" for e, x in (("n_", "src"), ("src", "_mean"), ("src", "_var"), ("n_", "dst"), ("dst", "_mean"), ("dst", "_var"))]
_all = WHOLE + [f"{k}_{c}" for k in ("mention", "retweet") for c in _link_names + _cols + _ego_names]
ORACLE_SQL["feature_wide"] = _sql(f"SELECT users.user_name, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _all)} FROM users LEFT JOIN f USING (user_name) LEFT JOIN {_side('mention')} AS m ON m.u = users.user_name LEFT JOIN {_side('retweet')} AS r ON r.u = users.user_name", _stats(ALL))
ORACLE_SQL |= {"retweet_internal_outlink_dict": ORACLE_SQL["tweet_dict"], "sort_posts_old": ORACLE_SQL["sort_posts"]}
