"""SQL that gives the rows of the corpus queries, written apart from the operators."""

from signalbook.llm.licenses import TEMPLATES

OP1 = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents
), totals AS (
    SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
        1.5 * sum(source_size) OVER () AS budget, 2.0 * source_size AS cap
    FROM totals
), levelled AS (
    SELECT *, cap / weight AS ratio,
        (budget - coalesce(sum(cap) OVER before, 0)) /
        (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed
    WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, source_size, budget,
        least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * weight, cap)) AS target
    FROM levelled
), queued AS (
    SELECT s.doc_id, s.size, t.source, t.target, t.budget, e.epoch, md5(':' || e.epoch || ':' || coalesce(s.doc_id::VARCHAR, 'null')) AS place
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (1), (2)) e(epoch)
), summed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY epoch, place, size
        ROWS UNBOUNDED PRECEDING) AS done
    FROM queued
), eligible AS (
    SELECT *, done / target AS finish FROM summed
    WHERE CASE WHEN size = 0 THEN epoch = 1 ELSE done - size / 2.0 <= target END
), cut AS (
    SELECT *, sum(size) OVER (ORDER BY finish, done - size, place, size ROWS UNBOUNDED PRECEDING) AS reached
    FROM eligible
), taken AS (
    SELECT doc_id, source, size, sum(size) AS taken FROM cut WHERE reached <= budget GROUP BY ALL
)
SELECT s.doc_id, s.size, t.source_size::BIGINT AS source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sized s
JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON k.doc_id IS NOT DISTINCT FROM s.doc_id AND k.source IS NOT DISTINCT FROM s.source AND k.size = s.size
"""

OP9 = """
WITH normal AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM normal
WINDOW same AS (PARTITION BY norm)
"""

OP3 = r"""
WITH cut AS (
    SELECT row_number() OVER () AS page, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), placed AS (
    SELECT page, doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM cut
), sizes AS (
    SELECT source, count(*) AS pages FROM documents GROUP BY source
), bad AS (
    SELECT p.source, trim(p.line) AS line
    FROM placed p JOIN sizes s ON p.source IS NOT DISTINCT FROM s.source
    WHERE trim(p.line) <> ''
    GROUP BY p.source, trim(p.line), s.pages
    HAVING count(DISTINCT page) >= 5 AND count(DISTINCT page) > 0.1::DOUBLE * s.pages
), marked AS (
    SELECT p.page, p.line, p.place, trim(p.line) <> '' AS full_line, b.line IS NOT NULL AS gone
    FROM placed p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source AND trim(p.line) = b.line
), joined AS (
    SELECT page, count(*) FILTER (full_line) AS full_lines, count(*) FILTER (gone) AS dropped_lines,
        string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone) AS text
    FROM marked GROUP BY page
)
SELECT c.doc_id, c.source, coalesce(j.full_lines, 0) AS full_lines, coalesce(j.dropped_lines, 0) AS dropped_lines,
    CASE WHEN c.text IS NOT NULL THEN coalesce(j.text, '') END AS text
FROM cut c LEFT JOIN joined j ON c.page = j.page
"""

OP5 = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), people AS (
    SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'
), seen AS (
    SELECT s.conv_id, p.perspective, s.turn, s.role AS speaker, s.text,
        CASE WHEN s.role = 'system' THEN '<|system|>' WHEN s.role = p.perspective THEN '<|assistant|>'
            ELSE '<|user:' || s.role || '|>' END || chr(10) AS head,
        s.text || '<|end|>' || chr(10) AS body
    FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
    SELECT *, row_number() OVER talk - 1 AS place, (sum(length(head) + length(body)) OVER talk - length(head) - length(body))::BIGINT AS start
    FROM seen
    WINDOW talk AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, turn, place, speaker, head, body, start,
    CASE WHEN speaker = perspective THEN start + length(head) END AS mask_start,
    CASE WHEN speaker = perspective THEN start + length(head) + length(body) END AS mask_end
FROM placed
"""

OP11 = r"""
WITH RECURSIVE leaf AS (
    SELECT row_number() OVER () AS row, doc_id, lang, text,
        concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
            CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
            CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
            CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
        list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
            lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, b: xor(xor(a::BIGINT, b::BIGINT) >> 1, CASE WHEN xor(a::BIGINT, b::BIGINT) % 2 = 1 THEN 3988292384 ELSE 0 END::BIGINT)) AS crc
    FROM documents
), hashed AS (
    SELECT row, doc_id, lang,
        sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        CASE WHEN xor(crc::BIGINT, 4294967295) % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' ||
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS spoilt
    FROM leaf
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS place,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
    FROM hashed
), nodes AS (
    SELECT tree, 0 AS level, place, leaf AS digest FROM placed
    UNION ALL
    SELECT tree, any_value(level) + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes)
    WHERE n > 1
    GROUP BY tree, place // 8
), sized AS (
    SELECT *, count(*) OVER (PARTITION BY tree, level) AS n FROM nodes
), subroots AS (
    SELECT tree, digest AS subroot FROM sized WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY tree ORDER BY level) = 1
), tops AS (
    SELECT 0 AS level, tree AS place, subroot AS digest FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER () AS n FROM tops)
    WHERE n > 1
    GROUP BY place // 8
), root AS (
    SELECT digest AS root FROM tops ORDER BY level DESC LIMIT 1
), around AS (
    SELECT tree, level, place,
        coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM sized WHERE n > 1
    WINDOW run AS (PARTITION BY tree, level, place // 8 ORDER BY place)
), above AS (
    SELECT level, place,
        coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM tops) WHERE n > 1
    WINDOW run AS (PARTITION BY level, place // 8 ORDER BY place)
), steps AS (
    SELECT p.row, a.level, a.l, a.r FROM placed p JOIN around a ON a.tree = p.tree AND a.place = p.place // (8 ** a.level)::BIGINT
    UNION ALL
    SELECT p.row, 100 + a.level, a.l, a.r FROM placed p JOIN above a ON a.place = p.tree // (8 ** a.level)::BIGINT
), proofs AS (
    SELECT row, list({'l': l, 'v': '', 'r': r} ORDER BY level) AS steps, string_agg(l || r, '' ORDER BY level) AS siblings
    FROM steps GROUP BY row
)
SELECT p.doc_id, p.leaf, s.subroot, root, sha256(coalesce(f.siblings, '')) AS proof_sha256,
    list_reduce(list_concat([{'l': '', 'v': coalesce(p.spoilt, p.leaf), 'r': ''}], coalesce(f.steps, [])),
        lambda a, b: {'l': '', 'v': sha256(b.l || a.v || b.r), 'r': ''}).v AS folded_root,
    folded_root = root AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree LEFT JOIN proofs f ON f.row = p.row, root
"""

OP12 = r"""
WITH said AS (
    SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), template AS (
    SELECT number, label, exact, string_split(phrase, ' ') AS words FROM (VALUES {templates}) t(number, label, exact, phrase)
), run AS (
    SELECT number, label, exact, len(words) AS size, unnest(range(len(words) - 2)) AS place,
        unnest(list_transform(range(len(words) - 2), lambda i: words[i + 1:i + 3])) AS gram
    FROM template
), heard AS (
    SELECT row, unnest(range(greatest(len(words) - 2, 0))) AS spot,
        unnest(list_transform(range(greatest(len(words) - 2, 0)), lambda i: words[i + 1:i + 3])) AS gram
    FROM said
), hit AS (
    SELECT h.row, r.number, r.label, r.exact, r.size, h.spot, r.place, h.spot - r.place AS diagonal
    FROM heard h JOIN run r ON h.gram = r.gram
), phrase AS (
    SELECT row, label, exact, diagonal AS start, 1.0::DOUBLE AS score
    FROM hit WHERE exact GROUP BY row, number, label, exact, size, diagonal HAVING count(DISTINCT place) = size - 2
), marked AS (
    SELECT *, coalesce(diagonal - lag(diagonal) OVER line > 3, true)::INT AS begins
    FROM hit WHERE NOT exact
    WINDOW line AS (PARTITION BY row, number ORDER BY diagonal, place)
), grouped AS (
    SELECT *, sum(begins) OVER (PARTITION BY row, number ORDER BY diagonal, place) AS cluster FROM marked
), merged AS (
    SELECT row, label, exact, size, min(spot) AS start, max(spot) + 3 AS stop,
        list_reduce(list_concat([{'last': -3, 'words': 0}], list({'last': place, 'words': 0} ORDER BY spot, place)),
            lambda a, b: CASE WHEN b.last > a.last
                THEN {'last': b.last, 'words': a.words + least(3, b.last - a.last)} ELSE a END).words AS held
    FROM grouped GROUP BY row, number, label, exact, size, cluster
), span AS (
    FROM phrase
    UNION ALL
    SELECT row, label, exact, start, held / size FROM merged WHERE held / size >= 0.8::DOUBLE AND stop - start <= 1.5 * size
), summed AS (
    SELECT row, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
    FROM span GROUP BY row
)
SELECT s.doc_id, len(s.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM said s LEFT JOIN summed USING (row)
""".replace(
    "{templates}",
    ", ".join(f"({number}, '{t.label}', {t.exact}, '{t.text}')" for number, t in enumerate(TEMPLATES)),
)

OP13 = r"""
WITH drawn AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
        sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS digest
    FROM documents
), cut AS (
    SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        list_transform([1, 9, 17, 25], lambda i: ('0x' || digest[i:i + 7])::BIGINT) AS h
    FROM drawn
), chosen AS (
    SELECT *, len(units)::BIGINT AS n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
            WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parted AS (
    SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf
    FROM chosen
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parted
"""

SQL = {
    "op3_line_dedup": OP3,
    "op5_chat_perspectives": OP5,
    "op1_mix_sources": OP1,
    "op9_exact_dedup": OP9,
    "op11_merkle_manifest": OP11,
    "op12_license_scan": OP12,
    "op13_fill_middle": OP13,
}
