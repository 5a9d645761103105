"""SQL fragments shared by the comparison queries."""

FOLD = "lower(strip_accents({0}))"


def fold(expr: str) -> str:
    return f"lower(strip_accents({expr}))"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda w: w <> '')"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(expr)}, '[^a-z0-9]+'), lambda w: w <> '')"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def slug(expr: str) -> str:
    return (
        f"regexp_replace(regexp_replace({fold(expr)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    )


def title(expr: str) -> str:
    return f"trim(regexp_extract({expr}, '^[^.\\n]*', 0))"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# 200-word windows with a 30-word overlap, one row per passage
CHUNKS = f"""
doc_words AS (
  SELECT doc_id, lang, source, {title('text')} AS title, {words('text')} AS w FROM documents
),
starts AS (
  SELECT doc_id, lang, source, title, w,
         unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1
                      ELSE 1 + CAST(ceil((len(w) - 200) / 170.0) AS BIGINT) END)) AS i
  FROM doc_words
),
chunks AS (
  SELECT doc_id, lang, source, title, CAST(i AS INTEGER) AS chunk_index,
         array_to_string(w[i * 170 + 1 : i * 170 + 200], ' ') AS content
  FROM starts
)"""

ITEMS = """
items AS (
  SELECT o_orderkey AS item_id, 'C' || o_custkey AS person,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS kind,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS collection,
         CAST(o_orderdate AS DATE) AS date, o_totalprice AS price
  FROM orders
),
refs AS (
  SELECT l_orderkey AS item_id, p_brand AS work, CAST(l_linenumber - 1 AS INTEGER) AS chapter,
         p_type AS topic
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
works AS (
  SELECT p_brand AS work, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS position,
         CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) <= 12
              THEN 'first' ELSE 'second' END AS section
  FROM part GROUP BY p_brand
)"""
