"""DuckDB SQL for the queries of the corpus operators that SQL can express."""

from martlib.llm.quality import DELTA, RISK, SIGNALS, STEPS

_SPACE = r"[\x20\x09-\x0D]+"

OP6 = r"""
WITH b AS (
    SELECT item_id, list_filter(string_split_regex(
        regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
    FROM benchmark WHERE text IS NOT NULL
), wb AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS k,
        array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
    FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(i) WHERE len(w) > 0
), d AS (
    SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(
        regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
    FROM documents
), ks AS (SELECT DISTINCT k FROM wb), p AS (
    SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
    FROM d, ks, unnest(range(1, greatest(len(w) - k, -1) + 2)) AS t(i)
), h AS (
    SELECT p.rid, p.i, p.k, wb.item_id FROM p JOIN wb ON p.win = wb.win AND p.k = wb.k
), n AS (
    SELECT rid, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + k)) AS t(j) GROUP BY rid
), s AS (
    SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""

OP5 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
        range(1, greatest(len(w) - 4, 0) + 2), lambda i: array_to_string(w[i : i + least(4, len(w)) - 1], ' '))) END AS sh
    FROM d
), g AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS x FROM g),
p AS (
    SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, reach) AS (SELECT rep, rep FROM g UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS comp FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp, s.doc_id) AS component_id,
    s.doc_id = coalesce(comp, s.doc_id) AS kept
FROM s LEFT JOIN g ON list_sort(s.sh) = g.sh LEFT JOIN c ON c.node = g.rep
"""


def quality_sql(source: str) -> str:
    """CTEs that end in ``judged``: every row of ``source`` with its counts and kept."""
    level = f"{DELTA} / (SELECT greatest(1, count(DISTINCT lang)) FROM good)"

    def above(step: int) -> str:
        return " OR ".join(f"{count} * 1000 > {per} * {cutoffs[step]}" for count, per, cutoffs in SIGNALS.values())

    ladder = " UNION ALL ".join(
        f"SELECT lang, {i} AS step, count(*) AS n, count(*) FILTER ({above(i)}) AS k FROM good GROUP BY lang"
        for i in range(STEPS)
    )
    rejected = " ".join(f"WHEN {i} THEN {above(i)}" for i in range(STEPS))
    p = RISK
    return rf"""
src AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {source}),
cut AS (
    SELECT *, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM src
), win AS (
    SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS x
    FROM cut, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS u(i)
), twice AS (
    SELECT rid, unnest(list(i)) AS i FROM win GROUP BY rid, x HAVING count(*) > 1
), covered AS (
    SELECT rid, count(DISTINCT j) AS n FROM twice, unnest(range(i, i + 8)) AS u(j) GROUP BY rid
), counted AS (
    SELECT cut.*, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(t) - len(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(t) - len(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_capitals,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        len(w) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(w) AS base_failed
    FROM cut LEFT JOIN covered USING (rid)
), good AS (
    SELECT c.* REPLACE (coalesce(lang, '') AS lang) FROM counted c
    WHERE NOT base_failed AND doc_id IN (
        SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1)
), ladder AS ({ladder}),
tested AS (
    SELECT *, k <= n * {p} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(
        lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) <= {level} AS proven
    FROM ladder
), chosen AS (
    SELECT lang, max(step) AS step FROM tested t
    WHERE step < (SELECT coalesce(min(step), 1000) FROM tested f WHERE f.lang = t.lang AND NOT f.proven)
    GROUP BY lang
), judged AS (
    SELECT q.*, NOT base_failed AND NOT coalesce(
        CASE (SELECT step FROM chosen x WHERE x.lang = coalesce(q.lang, '')) {rejected} END, FALSE) AS kept
    FROM counted q)
"""


OP4 = f"""WITH {quality_sql("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""


def lines_sql(source: str, min_sites: int = 10) -> str:
    """CTEs that end in ``relined``: rows of ``source`` with n_lines, n_removed, clean_text."""
    return rf"""
lsrc AS (SELECT *, row_number() OVER () AS lrid FROM {source}),
ln AS (
    SELECT lrid, doc_id, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM lsrc WHERE text IS NOT NULL
), lw AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS word FROM ln),
boil AS (
    SELECT line, min(doc_id) AS first FROM lw WHERE word GROUP BY line HAVING count(DISTINCT source) >= {min_sites}
), marked AS (
    SELECT lw.*, boil.line IS NOT NULL AND word AND NOT (
        doc_id IS NOT DISTINCT FROM first AND pos = min(pos) OVER (PARTITION BY lrid, lw.line)) AS gone
    FROM lw LEFT JOIN boil ON lw.line = boil.line
), rebuilt AS (
    SELECT lrid, count(*) FILTER (word) AS n_lines, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t
    FROM marked GROUP BY lrid
), relined AS (
    SELECT l.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
        CASE WHEN n_removed > 0 THEN t ELSE text END AS clean_text
    FROM lsrc l LEFT JOIN rebuilt USING (lrid)
)"""


OP2 = f"""WITH {lines_sql("documents")}
SELECT doc_id, n_lines, n_removed, sha256(clean_text) AS text_sha256 FROM relined
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text."""
    return (
        f"xor(list_reduce(list_transform(string_split({text}, ''), lambda z: CAST(ascii(z) AS BIGINT)), "
        "lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), "
        "xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"
    )


def _framed(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP11 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
        CASE WHEN coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0, FALSE) THEN {_leaf("n_chars + 1")}
            ELSE {_leaf("n_chars")} END AS presented
    FROM documents
), p AS (
    SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS cnt
    FROM d
), n AS (
    SELECT tree, 0 AS level, idx, leaf AS digest, cnt FROM p
    UNION ALL
    SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 1) // 2
    FROM n WHERE cnt > 1 GROUP BY tree, level, idx // 2, cnt
), t AS (
    SELECT 0 AS level, tree AS idx, digest, count(*) OVER () AS cnt FROM n WHERE cnt = 1
    UNION ALL
    SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 1) // 2
    FROM t WHERE cnt > 1 GROUP BY level, idx // 2, cnt
), ways AS (
    SELECT rid, level, (p.idx >> level) % 2 = 1 AS l, (SELECT digest FROM n s
        WHERE s.tree = p.tree AND s.level = w.level AND s.idx = xor(p.idx >> w.level, 1)) AS d
    FROM p JOIN (SELECT DISTINCT tree, level FROM n WHERE cnt > 1) w USING (tree)
    UNION ALL
    SELECT rid, 1000 + level, (p.tree >> level) % 2 = 1, (SELECT digest FROM t s
        WHERE s.level = w.level AND s.idx = xor(p.tree >> w.level, 1))
    FROM p, (SELECT DISTINCT level FROM t WHERE cnt > 1) w
), proofs AS (SELECT rid, list({{'l': l, 'd': d}} ORDER BY level) AS steps FROM ways GROUP BY rid),
done AS (
    SELECT p.*, coalesce(steps, []) AS steps FROM p LEFT JOIN proofs USING (rid)
), f AS (
    SELECT done.*, list_reduce(steps, lambda a, s: {{'l': FALSE, 'd': sha256(CASE WHEN s.d IS NULL THEN a.d
        WHEN s.l THEN s.d || a.d ELSE a.d || s.d END)}}, {{'l': FALSE, 'd': presented}}).d AS folded_root
    FROM done
)
SELECT doc_id, leaf, (SELECT digest FROM n WHERE n.tree = f.tree AND n.cnt = 1) AS subroot,
    (SELECT digest FROM t WHERE cnt = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(list_filter(steps, lambda s: s.d IS NOT NULL), lambda s: s.d), ''), '')) AS proof_sha256,
    folded_root, folded_root = (SELECT digest FROM t WHERE cnt = 1) AS verified
FROM f
"""

_NO_WORD = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP12 = rf"""
WITH RECURSIVE src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') AS c,
        {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code
    FROM conversations
), dam AS (
    SELECT c, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM src, (VALUES (1), (2)) AS u(copy) WHERE code <> 0 AND (copy = 1 OR code = 3)
), ord AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i,
        left(role, 1) AS ini, {_NO_WORD} AS body
    FROM dam
), f AS (
    SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
        lag(ini) OVER (PARTITION BY c ORDER BY i) AS prev
    FROM ord
), stats AS (
    SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY c
), ins(start, k, added, state) AS (
    VALUES (0, '', NULL, 0), (0, 'I', 'user:', 2), (0, 'II', 'user:' || chr(10) || 'assistant:', 3),
        (1, '', NULL, 1), (1, 'I', 'user:', 2), (1, 'II', 'user:' || chr(10) || 'assistant:', 3),
        (2, '', NULL, 2), (2, 'I', 'assistant:', 3), (2, 'II', 'assistant:' || chr(10) || 'user:', 2),
        (3, '', NULL, 3), (3, 'I', 'user:', 2), (3, 'II', 'user:' || chr(10) || 'assistant:', 3)
), fol(state, ini, nxt) AS (
    VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), moves AS (
    SELECT start, k || 'D' AS letters, added, 3 * length(k) + 4 AS cost, state AS nxt, 'D' AS edit, NULL AS ini FROM ins
    UNION ALL
    SELECT start, k || 'K', added, 3 * length(k), nxt, 'K', ini FROM ins JOIN fol USING (state)
    UNION ALL
    SELECT start, k || 'R', added, 3 * length(k) + 3, nxt, 'R', NULL FROM ins JOIN fol USING (state) WHERE ini <> 's'
), r AS (
    SELECT c, CAST(0 AS BIGINT) AS i, 0 AS st, 0 AS cost, '' AS audit, CAST(NULL AS VARCHAR) AS made FROM stats
    UNION ALL
    SELECT c, i, nxt, cost, audit, made FROM (
        SELECT r.c, f.i, m.nxt, r.cost + m.cost + CASE WHEN f.fault = 't' AND m.edit <> 'D' THEN 3 ELSE 0 END AS cost,
            r.audit || m.letters AS audit,
            nullif(concat_ws(chr(10), r.made, m.added, CASE m.edit WHEN 'K' THEN f.role || ':' || f.text
                WHEN 'R' THEN CASE m.nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text END), '') AS made
        FROM r JOIN f ON f.c = r.c AND f.i = r.i + 1 JOIN moves m ON m.start = r.st
        WHERE (m.edit = 'D' OR f.fault NOT IN ('b', 'd')) AND (m.ini IS NULL OR m.ini = f.ini)
    ) QUALIFY row_number() OVER (PARTITION BY c, nxt ORDER BY cost, audit) = 1
), ends AS (
    SELECT r.c, r.cost + 3 * length(k) AS cost, audit || k AS audit, concat_ws(chr(10), made, added) AS made
    FROM r JOIN stats ON stats.c = r.c AND stats.n = r.i JOIN ins ON ins.start = r.st WHERE state IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY r.c ORDER BY r.cost + 3 * length(k), audit || k) = 1
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM src) a LEFT JOIN stats USING (c) LEFT JOIN ends USING (c)
"""
