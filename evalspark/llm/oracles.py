"""SQL counterparts of queries whose SQL takes more than a few lines."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """The byte table of CRC-32, from its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of a text expression; null stays null."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = f"xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295), 4294967295)"


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, base: str) -> str:
    """A recursive table of the nodes ``grp, level, slot, run, node`` over a base of the same columns."""
    return f"""{name} AS (
        SELECT * FROM {base}
        UNION ALL
        SELECT grp, level + 1, slot // 2, (run + 1) // 2, sha256(node || coalesce(next, ''))
        FROM (SELECT *, lead(node) OVER (PARTITION BY grp ORDER BY slot) AS next FROM {name} WHERE run > 1)
        WHERE slot % 2 = 0)"""


def _paths(name: str, base: str, nodes: str) -> str:
    """For every row of the base, the list of its siblings: side and digest, or '-' for none."""
    return f"""{name} AS (
        SELECT b.grp, b.slot, list(CASE WHEN s.node IS NULL THEN '-' WHEN s.slot % 2 = 0 THEN '<' || s.node ELSE '>' || s.node END
                                   ORDER BY o.level) FILTER (o.run > 1) AS path
        FROM {base} b
        JOIN {nodes} o ON o.grp = b.grp AND o.slot = b.slot >> o.level
        LEFT JOIN {nodes} s ON s.grp = o.grp AND s.level = o.level AND s.slot = xor(o.slot, 1)
        GROUP BY b.grp, b.slot)"""


MERKLE = f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS changed,
               coalesce({crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS tampered
        FROM documents),
    grps AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT lang FROM documents)),
    placed AS (
        SELECT l.*, g.grp, row_number() OVER same - 1 AS slot, count(*) OVER (PARTITION BY g.grp) AS run
        FROM leaves l JOIN grps g ON l.lang IS NOT DISTINCT FROM g.lang
        WINDOW same AS (PARTITION BY g.grp ORDER BY doc_id NULLS FIRST, leaf)),
    base AS (SELECT grp, 0 AS level, slot, run, leaf AS node FROM placed),
    {_levels("nodes", "base")},
    {_paths("paths", "base", "nodes")},
    subroots AS (SELECT grp, node FROM nodes WHERE run = 1),
    upper_base AS (SELECT 0::BIGINT AS grp, 0 AS level, grp AS slot, (SELECT count(*) FROM subroots) AS run, node FROM subroots),
    {_levels("upper_nodes", "upper_base")},
    {_paths("upper_paths", "upper_base", "upper_nodes")},
    whole AS (
        SELECT p.doc_id, p.leaf, s.node AS subroot, (SELECT node FROM upper_nodes WHERE run = 1) AS root,
               CASE WHEN tampered THEN changed ELSE leaf END AS altered,
               list_concat(coalesce(a.path, []), coalesce(u.path, [])) AS path
        FROM placed p JOIN subroots s USING (grp) JOIN paths a USING (grp, slot) JOIN upper_paths u ON u.slot = p.grp),
    folded AS (
        SELECT *, sha256(array_to_string(list_transform(path, lambda e: e[2:]), '')) AS proof_sha256,
               list_reduce(path, lambda h, e: sha256(CASE WHEN e[1] = '<' THEN e[2:] || h ELSE h || e[2:] END), altered) AS folded_root
        FROM whole)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""

SPELLING = f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, run, count(*) AS times FROM (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
            FROM documents) GROUP BY ALL),
    hashed AS (SELECT run, times, {crc32("doc_id || ':' || run")} AS h FROM runs),
    slipped AS (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
    words AS (
        SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
    gaps AS (
        SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
        SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, w.word FROM gaps a JOIN words w ON a.rest = w.word
        UNION SELECT w.word, a.word FROM gaps a JOIN words w ON a.rest = w.word),
    ranked AS (
        SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
               row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS place
        FROM near JOIN words w ON w.word = other),
    formed AS (
        SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
               CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
        FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
    ways AS (
        SELECT word, word AS root FROM formed WHERE form IS NULL
        UNION ALL
        SELECT f.word, ways.root FROM formed f JOIN ways ON f.form = ways.word)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ways USING (word)"""

SHARDING = f"""
    WITH sized AS (
        SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '')) AS digest FROM documents),
    placed AS (
        SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY digest, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
               CAST(sum(size) OVER () AS BIGINT) AS total
        FROM sized),
    cut AS (SELECT *, (2 * before + size) * 16 // (2 * total) AS shard FROM placed),
    extents AS (
        SELECT digest, (min(before) + max(before + size)) * 16 // (2 * any_value(total)) AS side FROM cut GROUP BY digest
        HAVING min(shard) < max(shard) AND sum(size) * 16 <= any_value(total) * 0.01),
    moved AS (SELECT cut.* EXCLUDE (shard), CAST(coalesce(side, shard) AS INTEGER) AS shard FROM cut LEFT JOIN extents USING (digest))
    SELECT doc_id, CAST(size AS BIGINT) AS size, coalesce({crc32("nullif(text, '')")}, 0) AS text_crc32, 'bytes' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM moved"""
