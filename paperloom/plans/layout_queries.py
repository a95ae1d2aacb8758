"""Queries of layout reconstruction, over layouts made from the documents' lines.

Every document is a paper.  A line of text is a layout line; every three lines are a
block and every thirty a page.  Every ninth line is a bold heading.  A line with
`` | `` is a row of cells, some of them merged numbers, on nearly one baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import layout as L
from paperloom.plans.document_queries import body
from paperloom.plans.registry import PAPERS, papers, query, table
from paperloom.plans.text_queries import sql_strip


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("i", "raw")).where(F.trim("raw") != "")
    k = F.floor(F.col("i") / 9)
    heading = F.when(k % 4 == 0, F.concat((k % 90 + 1).cast("string"), F.lit(" Results"))).when(k % 4 == 1, F.concat((k % 90 + 1).cast("string"), F.lit(".1 Details of Work."))).when(k % 4 == 2, F.concat((k % 90).cast("string"), F.lit(".2 More Details"))).otherwise("References")
    is_table = F.contains("raw", F.lit(" | "))
    is_heading = ~is_table & (F.col("i") % 9 == 0)
    cells = F.when(is_table, F.split("raw", r" \| ")).when(is_heading, F.array(heading)).otherwise(F.array("raw"))
    rows = lines.select("paper_id", "i", is_table.alias("is_table"), is_heading.alias("is_heading"), F.posexplode(cells).alias("j", "cell")).where(F.trim("cell") != "")
    i, j = F.col("i"), F.col("j")
    number = F.when(j % 5 == 4, F.concat(F.length("cell").cast("string"), F.lit(".5 7%"))).when(j % 2 == 1, F.length("cell").cast("string")).otherwise(F.col("cell"))
    text = F.when(F.col("is_table") & (j > 0), number).otherwise(F.col("cell"))
    y = (100 + 12 * (i % 30)).cast("double") + F.when(F.col("is_table"), j % 3).otherwise(0)
    x = F.when(F.col("is_table"), 50.0 + 40 * j).otherwise(50.0)
    shaped = rows.select(
        "paper_id", (F.floor(i / 30) + 1).cast("int").alias("page"), F.floor(i / 3).cast("int").alias("block"), (i * 1000 + j).cast("int").alias("line"), text.alias("whole"), "is_heading",
        F.when(F.col("is_heading"), 16).otherwise(0).alias("flags"), F.lit("Serif").alias("font"), F.when(F.col("is_heading"), 12.04).otherwise(10.02).alias("size"),
        x.alias("x0"), y.alias("y0"), F.when(F.col("is_table"), x + 30).when(F.col("is_heading"), 120.0).otherwise(500.0).alias("x1"), (y + 10).alias("y1"),
    )
    # the first word is a span of its own, the rest another, with blanks between
    parts = F.array(F.split("whole", " ", 2)[0], F.lit("  "), F.coalesce(F.get(F.split("whole", " ", 2), F.lit(1)), F.lit("")))
    return shaped.select("*", F.posexplode(parts).alias("span", "text")).drop("whole", "is_heading")


LINES = rf"""raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS raw FROM documents
), kinds AS (SELECT *, contains(raw, ' | ') AS is_table, NOT contains(raw, ' | ') AND i % 9 = 0 AS is_heading, i // 9 AS k FROM raw WHERE trim(raw) <> ''), split AS (
  SELECT *, CASE WHEN is_table THEN string_split(raw, ' | ') WHEN is_heading THEN [CASE k % 4 WHEN 0 THEN (k % 90 + 1) || ' Results' WHEN 1 THEN (k % 90 + 1) || '.1 Details of Work.' WHEN 2 THEN (k % 90) || '.2 More Details' ELSE 'References' END] ELSE [raw] END AS cells FROM kinds
), cells0 AS (SELECT paper_id, i, is_table, is_heading, generate_subscripts(cells, 1) - 1 AS j, unnest(cells) AS cell FROM split), lines AS (
  SELECT paper_id, CAST(i // 30 + 1 AS INTEGER) AS page, CAST(i // 3 AS INTEGER) AS block, CAST(i * 1000 + j AS INTEGER) AS line,
    {sql_strip(r"regexp_replace(CASE WHEN is_table AND j > 0 THEN CASE WHEN j % 5 = 4 THEN length(cell) || '.5 7%' WHEN j % 2 = 1 THEN CAST(length(cell) AS VARCHAR) ELSE cell END ELSE cell END, '^(\S*)\s+', '\1 ')")} AS text,
    is_heading AS bold, CASE WHEN is_heading THEN 12.0 ELSE 10.0 END AS size, i, is_table,
    CAST(100 + 12 * (i % 30) + CASE WHEN is_table THEN j % 3 ELSE 0 END AS DOUBLE) AS y0, CASE WHEN is_table THEN 50.0 + 40 * j ELSE 50.0 END AS x0, CASE WHEN is_table THEN 80.0 + 40 * j WHEN is_heading THEN 120.0 ELSE 500.0 END AS x1
  FROM cells0 WHERE trim(cell) <> ''
)"""


@query(f"WITH {LINES} SELECT paper_id, page, block, line, text, bold, CAST(size AS DOUBLE) AS size, CAST(x0 AS DOUBLE) AS x0, y0 FROM lines")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.layout_lines(spans(spark, sf_dir)).select("paper_id", "page", "block", "line", "text", "bold", "size", "x0", "y0")


@query(
    f"""
WITH {LINES}, w AS (SELECT paper_id, size, sum(length(text)) AS n FROM lines GROUP BY ALL)
SELECT paper_id, CAST(size AS DOUBLE) AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, size) AS z FROM w) WHERE z = 1
"""
)
def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.body_sizes(L.layout_lines(spans(spark, sf_dir)))


#: Baselines of the made layouts are 12 apart and cells of a row at most 2, so a row is a line's number.
CELLS = rf"""{LINES}, blocks AS (SELECT paper_id, page, block, count(*) AS n, min(y0) AS top FROM lines GROUP BY ALL), rows0 AS (
  SELECT paper_id, page, block, i, count(*) AS width FROM lines GROUP BY ALL
), tables AS (
  SELECT b.paper_id, b.page, b.block, top FROM blocks b JOIN (SELECT paper_id, page, block, max(width) AS widest FROM rows0 GROUP BY ALL) r ON b.paper_id = r.paper_id AND b.page = r.page AND b.block = r.block WHERE n >= 3 AND widest >= 3
), tlines AS (
  SELECT l.*, t.top, string_split_regex(l.text, '\s+') AS pieces, dense_rank() OVER (PARTITION BY l.paper_id, l.page, l.block ORDER BY l.i) - 1 AS row FROM lines l JOIN tables t ON l.paper_id = t.paper_id AND l.page = t.page AND l.block = t.block
), tparts AS (
  SELECT *, len(pieces) > 1 AND len(list_filter(pieces, lambda p: NOT regexp_matches(p, '{L.NUMERIC_CELL}'))) = 0 AS merged FROM tlines
), exploded AS (
  SELECT paper_id, page, block, top, row, x0, x1, line, merged, generate_subscripts(CASE WHEN merged THEN pieces ELSE [text] END, 1) - 1 AS part, unnest(CASE WHEN merged THEN pieces ELSE [text] END) AS text, len(pieces) AS n_parts FROM tparts
), cells AS (
  SELECT paper_id, page, block, top, CAST(row AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY paper_id, page, block, row ORDER BY x0, line, part) - 1 AS INTEGER) AS cell,
    CAST(CASE WHEN merged THEN x0 + (x1 - x0) / n_parts * (part + 0.5) ELSE (x0 + x1) / 2 END AS DOUBLE) AS x, text FROM exploded
)"""


@query(f"WITH {CELLS} SELECT paper_id, page, block, row, cell, round(x, 4) AS x, text FROM cells", name="table_rows")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_cells(L.layout_lines(spans(spark, sf_dir))).select("paper_id", "page", "block", "row", "cell", F.round("x", 4).alias("x"), "text")


HEADERS = rf"""{CELLS}, data_rows AS (SELECT DISTINCT paper_id, page, block, row FROM cells WHERE cell > 0 AND regexp_matches(text, '{L.NUMERIC_CELL}')), widths AS (
  SELECT paper_id, page, block, row, count(*) AS n FROM cells GROUP BY ALL
), widest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, page, block ORDER BY n DESC, row) AS z FROM widths) WHERE z = 1), centres AS (
  SELECT c.paper_id, c.page, c.block, c.x FROM cells c JOIN widest w ON c.paper_id = w.paper_id AND c.page = w.page AND c.block = w.block AND c.row = w.row WHERE cell > 0
), short AS (
  SELECT * FROM lines WHERE length(text) <= {L.HEADER_CHARS} AND regexp_matches(text, '\p{{L}}') AND NOT regexp_matches(replace(text, ' ', ''), '{L.NUMERIC_CELL}')
), covering AS (
  SELECT t.paper_id, t.page, t.block, s.block AS h_block, s.line AS h_line, count(*) FILTER (c.x BETWEEN s.x0 - 3 AND s.x1 + 3) AS n FROM tables t JOIN short s ON t.paper_id = s.paper_id AND t.page = s.page AND t.block <> s.block
  JOIN centres c ON c.paper_id = t.paper_id AND c.page = t.page AND c.block = t.block GROUP BY ALL
), headers AS (
  SELECT paper_id, page, block, row, cell, header FROM (
    SELECT c.*, s.text AS header, row_number() OVER (PARTITION BY c.paper_id, c.page, c.block, c.row, c.cell ORDER BY s.y0 DESC, s.block, s.line) AS z
    FROM cells c JOIN data_rows d ON c.paper_id = d.paper_id AND c.page = d.page AND c.block = d.block AND c.row = d.row
    JOIN covering v ON v.paper_id = c.paper_id AND v.page = c.page AND v.block = c.block AND v.n < 3
    JOIN short s ON s.paper_id = v.paper_id AND s.page = v.page AND s.block = v.h_block AND s.line = v.h_line
    WHERE c.cell > 0 AND c.x BETWEEN s.x0 - 3 AND s.x1 + 3 AND s.y0 >= c.top - {L.HEADER_HEIGHT} AND s.y0 < c.top
  ) WHERE z = 1
)"""


@query(f"WITH {HEADERS} SELECT * FROM headers")
def column_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.layout_lines(spans(spark, sf_dir))
    return L.column_headers(L.table_cells(lines), lines)


RENDERED = f"""{HEADERS}, rendered AS (
  SELECT c.paper_id, c.page, c.block, c.row, string_agg(coalesce(header || ': ', '') || text, ' | ' ORDER BY c.cell) AS text
  FROM cells c LEFT JOIN headers h ON c.paper_id = h.paper_id AND c.page = h.page AND c.block = h.block AND c.row = h.row AND c.cell = h.cell GROUP BY ALL
)"""


@query(f"WITH {RENDERED} SELECT * FROM rendered")
def table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.layout_lines(spans(spark, sf_dir))
    cells = L.table_cells(lines)
    return L.table_rows(cells, L.column_headers(cells, lines))


#: The made headings are bold lines outside tables; "n.1 Details of Work." ends in a full stop and is none.
READ = rf"""{RENDERED}, reading AS (
  SELECT paper_id, page, block, line AS ord, text, bold, false AS is_row FROM lines l WHERE NOT EXISTS (SELECT 1 FROM tables t WHERE t.paper_id = l.paper_id AND t.page = l.page AND t.block = l.block)
  UNION ALL SELECT paper_id, page, block, row, text, false, true FROM rendered
), flagged AS (
  SELECT *, row_number() OVER w AS o, CASE WHEN bold AND NOT ends_with(text, '.') THEN 1 ELSE 0 END AS head FROM reading WINDOW w AS (PARTITION BY paper_id ORDER BY page, block, ord)
), parted AS (
  SELECT *, sum(head) OVER (PARTITION BY paper_id ORDER BY o) AS part FROM flagged
), heads AS (
  SELECT paper_id, part, page, regexp_extract(text, '^([0-9.]+) ', 1) AS number, regexp_replace(text, '^[0-9.]+ ', '') AS label FROM parted WHERE head = 1
)"""


@query(f"WITH {READ} SELECT paper_id, CAST(part AS INTEGER) AS place, label, CASE WHEN number <> '' THEN number END AS number, CAST(1 AS INTEGER) AS n_lines FROM heads")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.headings(L.layout_lines(spans(spark, sf_dir)))


SECTIONS = rf"""{READ}, tops AS (
  SELECT *, max(CASE WHEN NOT contains(number, '.') THEN part END) OVER (PARTITION BY paper_id ORDER BY part) AS top FROM heads
), named AS (
  SELECT t.paper_id, t.part, t.page, t.label, CASE WHEN contains(t.number, '.') THEN coalesce(CASE WHEN p.number <> '' THEN p.number || ' ' ELSE '' END || p.label || ' › ', '') ELSE '' END || CASE WHEN t.number <> '' THEN t.number || ' ' ELSE '' END || t.label AS heading
  FROM tops t LEFT JOIN heads p ON p.paper_id = t.paper_id AND p.part = t.top
), pars AS (
  SELECT r.paper_id, r.part, r.page, r.block, regexp_replace(string_agg(CASE WHEN is_row THEN chr(10) ELSE chr(1) END || text, '' ORDER BY o), '-\x01(\p{{Ll}})', '\1', 'g') AS text, min(o) AS o, bool_or(is_row) AS is_row
  FROM parted r LEFT JOIN heads h ON h.paper_id = r.paper_id AND h.part = r.part WHERE head = 0 GROUP BY ALL
), body AS (
  SELECT p.paper_id, p.part, p.page, p.block, p.o, replace(substr(p.text, 2), chr(1), ' ') AS text FROM pars p LEFT JOIN named n ON n.paper_id = p.paper_id AND n.part = p.part WHERE coalesce(n.label, '') <> 'References'
), pages AS (SELECT paper_id, max(page) AS last FROM reading GROUP BY 1), ends AS (
  SELECT paper_id, part, lead(page) OVER (PARTITION BY paper_id ORDER BY part) AS next_page FROM (SELECT paper_id, 0 AS part, 1 AS page FROM pages UNION ALL SELECT paper_id, part, page FROM heads)
), sections AS (
  SELECT b.paper_id, b.part, CAST(row_number() OVER (PARTITION BY b.paper_id ORDER BY b.part) - 1 AS INTEGER) AS section_index, coalesce(n.heading, 'Front Matter') AS heading, content, CAST(coalesce(n.page, 1) AS INTEGER) AS page_start, CAST(coalesce(e.next_page, last) AS INTEGER) AS page_end
  FROM (SELECT paper_id, part, string_agg(text, chr(10) || chr(10) ORDER BY o) AS content FROM body GROUP BY ALL) b
  LEFT JOIN named n ON n.paper_id = b.paper_id AND n.part = b.part JOIN ends e ON e.paper_id = b.paper_id AND e.part = b.part JOIN pages g ON g.paper_id = b.paper_id
)"""


@query(f"WITH {SECTIONS} SELECT paper_id, section_index, heading, content, page_start, page_end FROM sections")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sections(L.layout_lines(spans(spark, sf_dir))).drop("paragraph_pages")


@query(f"WITH {SECTIONS} SELECT b.paper_id, s.section_index, CAST(row_number() OVER (PARTITION BY b.paper_id, b.part ORDER BY o) - 1 AS INTEGER) AS place, text, CAST(page AS INTEGER) AS page FROM body b JOIN sections s ON s.paper_id = b.paper_id AND s.part = b.part")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.paragraphs(L.sections(L.layout_lines(spans(spark, sf_dir))))


@query(
    f"""
WITH {SECTIONS}, entries AS (
  SELECT r.paper_id, r.part, r.page, r.block, string_agg(r.text, ' ' ORDER BY o) AS entry, min(o) AS o FROM parted r JOIN heads h ON h.paper_id = r.paper_id AND h.part = r.part AND h.label = 'References' WHERE head = 0 GROUP BY ALL
), joined AS (
  -- a list that goes on after other sections goes on in its open entry if that is still the same block
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY o) AS place FROM entries
)
SELECT paper_id, CAST(place AS INTEGER) AS place, entry FROM joined WHERE place <= 30
"""
)
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.references(L.layout_lines(spans(spark, sf_dir)))


# --- plain text --------------------------------------------------------------


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, every eighth replaced by a known section name."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    n = F.col("line")
    text = F.when(n % 8 == 5, F.element_at(F.array(F.lit("2. Methods and data"), F.lit("RESULTS"), F.lit("IV Related Work")), (F.floor(n / 8) % 3 + 1).cast("int"))).otherwise(F.col("text"))
    return rows.select("paper_id", (F.floor(n / 20) + 1).cast("int").alias("page"), "line", text.alias("text"))


PLAIN = rf"""plain AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS raw FROM documents
), typed AS (
  SELECT paper_id, line, CAST(line // 20 + 1 AS INTEGER) AS page, {sql_strip("CASE WHEN line % 8 = 5 THEN ['2. Methods and data', 'RESULTS', 'IV Related Work'][(line // 8) % 3 + 1] ELSE raw END")} AS text FROM plain
), marked AS (
  SELECT *, regexp_matches(regexp_replace(text, '[^\x00-\x7F]', 'Q', 'g'), '(?i)^(?:[0-9IVXLCDM]+\.?\s+)?(?:{"|".join(L.KNOWN_SECTIONS)})\b') AND length(text) < 60 AS head FROM typed
), parted AS (
  SELECT *, sum(CAST(head AS INTEGER)) OVER w AS part, lead(page) OVER w AS next_page FROM marked WINDOW w AS (PARTITION BY paper_id ORDER BY page, line)
), plain_sections AS (
  SELECT paper_id, CAST(part AS INTEGER) AS section_index, coalesce(max(CASE WHEN head THEN text END), 'Main Text') AS heading, string_agg(text, chr(10) ORDER BY page, line) FILTER (NOT head) AS content,
    CASE WHEN part = 0 THEN 1 ELSE min(page) END AS page_start, max(coalesce(next_page, page)) AS page_end FROM parted GROUP BY paper_id, part HAVING count(*) FILTER (NOT head) > 0
)"""


@query(f"WITH {PLAIN} SELECT paper_id, section_index, heading, content, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end FROM plain_sections")
def plaintext_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.plain_sections(plain_lines(spark, sf_dir))


@query(
    f"""
WITH {PAPERS}, given AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, doc_id % 7 AS section_index, CASE WHEN doc_id % 25 = 7 THEN 'References' WHEN doc_id % 25 = 8 THEN 'Abstract' ELSE source END AS heading, text AS content FROM documents WHERE doc_id % 4 <> 0
), state AS (
  SELECT p.paper_id, p.abstract, g.n, g.has, CASE WHEN g.n IS NULL THEN 'no text: abstract only' WHEN g.n < 300 THEN 'little text: abstract added' END AS warning
  FROM papers p LEFT JOIN (SELECT paper_id, sum(length(content)) AS n, bool_or(contains(lower(heading), 'abstract')) AS has FROM given GROUP BY 1) g ON g.paper_id = p.paper_id
), added AS (SELECT paper_id, -1 AS section_index, 'Abstract' AS heading, abstract AS content FROM state WHERE warning IS NOT NULL OR (NOT has AND abstract <> ''))
SELECT b.paper_id, CAST(b.section_index AS INTEGER) AS section_index, b.heading, b.content, s.warning FROM (SELECT * FROM added UNION ALL SELECT * FROM given) b JOIN state s ON s.paper_id = b.paper_id
"""
)
def ensure_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth paper has no section; some have an Abstract heading."""
    given = body(spark, sf_dir).where(F.col("paper_id").cast("long") % 4 != 0)
    given = given.withColumn("heading", F.when(F.col("paper_id").cast("long") % 25 == 8, "Abstract").otherwise(F.col("heading")))
    return L.ensure_abstract(papers(spark, sf_dir), given).drop("page_start", "page_end")
