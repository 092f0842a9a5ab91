"""DuckDB twins of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

CHAT = """
WITH turns AS (
  SELECT *, md5(coalesce(turn::VARCHAR, '-') || '|' || coalesce(length(role)::VARCHAR || ':' || role, '-') || '|' || coalesce('t' || text, '-')) AS h
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS place FROM turns),
said AS (
  SELECT conv_id, count(*) AS n,
         list(coalesce(turn::VARCHAR, '-') || '|' || coalesce('r' || role, '-') || '|' || coalesce('t' || text, '-') ORDER BY place) AS l
  FROM placed GROUP BY conv_id),
prefix AS (SELECT conv_id, n, k, md5(array_to_string(l[1:k], chr(0))) AS h FROM said, unnest(range(1, n + 1)) AS t(k)),
maximal AS (
  SELECT p.h, min(p.conv_id) AS conv_id, count(*) AS copies FROM prefix p
  WHERE p.k = p.n AND NOT EXISTS (SELECT 1 FROM prefix q WHERE q.k < q.n AND q.k = p.k AND q.h = p.h)
  GROUP BY p.h, p.n),
parts AS (
  SELECT conv_id, (place - 1) // 256 AS part, count(*) AS part_turns,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
  FROM placed GROUP BY 1, 2)
SELECT m.conv_id, p.part, s.n AS n_turns, m.copies, p.part_turns, p.text
FROM maximal m JOIN said s ON s.conv_id IS NOT DISTINCT FROM m.conv_id JOIN parts p ON p.conv_id IS NOT DISTINCT FROM m.conv_id
"""

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents),
windows AS (
  SELECT r, p, array_to_string(w[p:p + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS t(p)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT p + o) AS n_repeat_words FROM again, range(0, 8) AS t(o) GROUP BY r),
tops AS (SELECT r, max(c) AS top_word FROM (SELECT r, x, count(*) AS c FROM d, unnest(w) AS t(x) GROUP BY r, x) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM d, unnest(string_split(text, chr(10))) AS t(x) WHERE len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) > 0 GROUP BY r),
facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(top_word, 0) AS top_word,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same_next,
         len(list_filter(w, lambda x: regexp_matches(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]'))) AS letter_words
  FROM d LEFT JOIN repeated USING (r) LEFT JOIN tops USING (r) LEFT JOIN lines USING (r)),
base AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines
            OR 100 * same_next > 30 * n_words OR 100 * n_repeat_words > 30 * n_words OR 10 * top_word > 4 * n_words OR 10 * letter_words < 6 * n_words) AS kept
FROM base
"""

_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')"
_PATH = r"regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '')"

WARC = rf"""
WITH p AS (
  SELECT page_id AS i, regexp_replace(trim(url), '#.*$', '') AS u, md5(html) AS digest, '"' || left(md5(html), 16) || '"' AS tag, 'day ' || (page_id // 100) AS changed FROM pages),
c AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS q FROM p),
k AS (SELECT *, {_HOST} || {_PATH} || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM c),
answers AS (SELECT 2 * i AS id, key, 10 * i AS t, tag, changed, digest FROM k),
again AS (
  SELECT 2 * i + 1 AS id, key, CASE WHEN i % 7 = 0 THEN -1 - i ELSE 10 * i + 250003 END AS t,
         CASE WHEN i % 3 = 0 THEN NULL WHEN i % 5 = 0 THEN '"other"' ELSE tag END AS tag, CASE WHEN i % 3 = 0 THEN changed END AS changed FROM k),
latest AS (
  SELECT g.id, max_by(a.id, (a.t, a.id)) AS from_id FROM again g JOIN answers a ON a.key = g.key AND (a.t, a.id) < (g.t, g.id) GROUP BY g.id),
checked AS (
  SELECT g.*, l.from_id, a.tag AS a_tag, a.changed AS a_changed, a.digest,
         CASE WHEN l.from_id IS NULL THEN 'no_response'
              WHEN coalesce(g.tag = a.tag, TRUE) AND coalesce(g.changed = a.changed, TRUE) AND (g.tag IS NOT NULL OR g.changed IS NOT NULL) THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM again g LEFT JOIN latest l USING (id) LEFT JOIN answers a ON a.id = l.from_id)
SELECT id AS record_id, key AS canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN from_id END AS response_id, CASE WHEN outcome = 'resolved' THEN digest END AS digest,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || t || chr(10) || 'etag: ' || a_tag || chr(10) || 'last-modified: ' || coalesce(changed, a_changed)
            ELSE 'cache-control: max-age=60' || chr(10) || 'content-type: text/plain' || chr(10) || 'date: ' || t
                 || coalesce(chr(10) || 'etag: ' || CASE WHEN tag = '"other"' THEN tag ELSE 'W/' || tag END, '') || coalesce(chr(10) || 'last-modified: ' || changed, '') END AS headers
FROM checked
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item, least(13, len(w)) AS k, array_to_string(w[p:p + 12], ' ') AS g FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(p) WHERE len(w) > 0),
grams AS (
  SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM windows) AS s, unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(p)),
found AS (SELECT r, p, windows.k, item FROM grams JOIN windows ON windows.g = grams.g AND windows.k = grams.k),
hit AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM found, unnest(range(0, k)) AS t(o) GROUP BY r),
held AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM found GROUP BY r),
occ AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
seen AS (SELECT t, count(*) AS c FROM occ GROUP BY t),
phrases AS (SELECT DISTINCT g FROM windows),
spread AS (SELECT g, unnest(string_split(g, ' ')) AS t, unnest(range(1, len(string_split(g, ' ')) + 1)) AS o FROM phrases),
terms AS (SELECT g, t, min(o) AS o FROM spread GROUP BY g, t),
ranked AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY coalesce(c, 0), o) AS k FROM terms LEFT JOIN seen USING (t)),
rare AS (SELECT g, list(t ORDER BY k) AS ts FROM ranked WHERE k <= 6 GROUP BY g),
sets AS (SELECT row_number() OVER () AS s, ts FROM (SELECT DISTINCT ts FROM rare) AS x),
anchors AS (SELECT s, r, p FROM sets JOIN occ ON occ.t = sets.ts[1]),
others AS (SELECT s, unnest(ts[2:]) AS t FROM sets),
beside AS (SELECT DISTINCT a.s, a.r, a.p, o.t FROM anchors a JOIN others o ON o.s = a.s JOIN occ ON occ.r = a.r AND occ.t = o.t AND occ.p BETWEEN a.p - 12 AND a.p + 12),
met AS (
  SELECT s, r, p FROM beside GROUP BY s, r, p HAVING count(*) = (SELECT len(ts) - 1 FROM sets WHERE sets.s = beside.s)
  UNION ALL SELECT s, r, p FROM anchors JOIN sets USING (s) WHERE len(ts) = 1),
close AS (
  SELECT r, count(DISTINCT item) AS n_near, string_agg(DISTINCT item, ',' ORDER BY item) AS near
  FROM (SELECT DISTINCT s, r FROM met) AS m JOIN sets USING (s) JOIN rare USING (ts) JOIN windows ON windows.g = rare.g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r) LEFT JOIN close USING (r)
"""


def _written(x: str) -> str:
    return f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"


def _tree(name: str, levels: int) -> list[str]:
    """Levels of the trees of ``name``0 (tree, pos, n, digest) and the siblings on each, ``name``_s0 and so on."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 8)")
        run = "OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}_s{k} AS (SELECT tree, pos, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
          coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)""")
    out.append(f"{name}_top AS (" + " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    return out


def _fold(name: str, first: str, tree: str, place: str, levels: int) -> list[str]:
    """Fold the rows of ``first`` (digest, proof) with their siblings, level by level, into ``name``_f."""
    out, before = [], first
    for k in range(levels):
        now = f"{name}_f" if k == levels - 1 else f"{name}_f{k}"
        out.append(f"""{now} AS (SELECT f.* REPLACE (CASE WHEN s.pos IS NULL THEN f.digest ELSE sha256(s.l || f.digest || s.r) END AS digest, f.proof || coalesce(s.l || s.r, '') AS proof)
          FROM {before} f LEFT JOIN {name}_s{k} s ON s.tree = {tree} AND s.pos = {place} // {8 ** k})""")
        before = now
    return out


#: Levels written out: 8 ** 8 rows a language, 8 ** 4 languages.
_LEAF = " || ".join(_written(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_CHECKED = " || ".join(_written(c) for c in ("doc_id", "source", "lang", "n_chars", "CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"))
MANIFEST = ",\n".join([
    "WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8)",
    "crcs AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8)",
    """d AS (SELECT documents.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
          lambda s, b: xor(tab[1 + xor(s, b) % 256], s >> 8)), 4294967295) AS crc FROM documents, crcs)""",
    f"leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_LEAF}) AS leaf, sha256({_CHECKED}) AS checked FROM d)",
    """places AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, checked) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves)""",
    "g0 AS (SELECT tree, pos, n, leaf AS digest FROM places)", *_tree("g", 8),
    "groups AS (SELECT tree AS grp, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM g_top)",
    "u0 AS (SELECT '' AS tree, pos, n, digest FROM groups)", *_tree("u", 4),
    "first AS (SELECT p.doc_id, p.tree, p.pos, p.leaf, g.pos AS place, g.digest AS subroot, p.checked AS digest, '' AS proof FROM places p JOIN groups g ON g.grp = p.tree)",
    *_fold("g", "first", "f.tree", "f.pos", 8), *_fold("u", "g_f", "''", "f.place", 4),
]) + """
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, u_f.digest AS folded_root, u_f.digest = t.digest AS verified FROM u_f, u_top t
"""
