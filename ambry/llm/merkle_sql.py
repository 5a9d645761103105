"""The SQL that gives the rows of ``op11_merkle_manifest``."""

#: the checksum of a decimal number's digits, bit by bit; {0} is a string
CRC32 = """xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda d: ascii(d)::UBIGINT)),
    lambda c, d: list_reduce(list_prepend(xor(c, d), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                          lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)
), 4294967295::UBIGINT)"""


def _leaf(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


MANIFEST = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, {_leaf('text')} AS leaf,
        CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 2 = 0
             THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS other
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos,
        count(*) OVER (PARTITION BY src) AS n
    FROM hashed
), below AS (
    SELECT src, 0 AS level, pos, leaf AS digest, n FROM leaves
    UNION ALL
    SELECT src, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
    FROM below WHERE n > 1 GROUP BY src, level, pos // 3
), subroots AS (
    SELECT src AS pos, digest, count(*) OVER () AS n FROM below WHERE n = 1
), upper AS (
    SELECT 0 AS level, pos, digest, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
    FROM upper WHERE n > 1 GROUP BY level, pos // 3
), path AS (
    SELECT src, pos AS leaf_pos, other AS digest, 0 AS storey, 0 AS level, pos AS here, n, '' AS proof FROM leaves
    UNION ALL
    (SELECT src, leaf_pos, sha256(string_agg(CASE WHEN mine THEN digest ELSE theirs END, '' ORDER BY place)),
        any_value(storey), any_value(level) + 1, any_value(here) // 3, (any_value(n) + 2) // 3,
        any_value(proof) || coalesce(string_agg(theirs, '' ORDER BY place) FILTER (WHERE NOT mine), '')
    FROM (
        SELECT p.*, b.pos AS place, b.pos = p.here AS mine, b.digest AS theirs
        FROM path p JOIN below b ON p.storey = 0 AND p.n > 1 AND b.src = p.src AND b.level = p.level AND b.pos // 3 = p.here // 3
        UNION ALL
        SELECT p.*, u.pos, u.pos = p.here, u.digest
        FROM path p JOIN upper u ON p.storey = 1 AND p.n > 1 AND u.level = p.level AND u.pos // 3 = p.here // 3
    ) GROUP BY src, leaf_pos
    UNION ALL
    SELECT src, leaf_pos, digest, 1, 0, src, (SELECT count(*) FROM subroots), proof FROM path WHERE storey = 0 AND n = 1)
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(p.proof) AS proof_sha256,
    p.digest AS folded_root, p.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON s.pos = l.src
JOIN path p ON p.src = l.src AND p.leaf_pos = l.pos AND p.storey = 1 AND p.n = 1
CROSS JOIN (SELECT digest FROM upper WHERE n = 1) r
"""
