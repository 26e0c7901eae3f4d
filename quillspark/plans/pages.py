"""Queries on page bundles and on extracted text, and their SQL."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lectures, pages as P
from . import fixtures as I

Q, SQL = {}, {}

SECTIONS = {"form": "FORM", "scan": "SCAN", "images": "IMAGES", "more_images": "MORE", "text_layer": "LAYER"}

PAGE_TEXT = "page_text AS (SELECT doc_id // 10 AS bundle_id, (doc_id % 10 + 1)::INT AS page_number, CASE WHEN doc_id % 29 = 0 THEN ' ' || chr(10) || ' ' WHEN doc_id % 13 = 0 THEN chr(1) || 'a' || chr(7) || coalesce(text, '') || chr(1) ELSE text END AS raw_text, (doc_id * 7 % 50)::INT AS annotation_count, doc_id FROM documents)"
#: Sanitising in SQL: control characters to blanks, then stripped.
LAYERS = r"""layers AS (SELECT bundle_id, page_number, annotation_count, doc_id, clean <> '' AS has_text, length(clean)::INT AS char_count, (length(raw) - length(regexp_replace(raw, '[\x01\x07]', '', 'g')))::INT AS control_character_count,
    CASE WHEN raw LIKE '%' || chr(1) || '%' THEN [1, 7] ELSE []::INT[] END AS control_character_codes, CASE WHEN clean <> '' THEN sha256(clean) END AS text_sha256, left(clean, 12000) AS prompt_text
  FROM (SELECT *, coalesce(raw_text, '') AS raw, regexp_replace(regexp_replace(coalesce(raw_text, ''), '[\x01\x07]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM page_text))"""
BLOCKS = """blocks AS (SELECT *, CASE WHEN bbox IS NULL THEN 0 ELSE bbox[3] - bbox[1] END AS w, CASE WHEN bbox IS NULL THEN 0 ELSE bbox[4] - bbox[2] END AS h FROM (
  SELECT l_orderkey // 100 AS bundle_id, (l_orderkey % 10 + 1)::INT AS page_number, (row_number() OVER (PARTITION BY l_orderkey // 100, l_orderkey % 10 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))::INT AS block_seq,
    CASE WHEN l_partkey % 97 <> 0 THEN [l_quantity, (l_partkey % 700)::DOUBLE, l_quantity + l_suppkey * 3 % 620, l_partkey % 700 + l_partkey % 800] END AS bbox, CASE WHEN l_partkey % 23 <> 0 THEN sha256((l_partkey % 500)::VARCHAR) END AS digest FROM lineitem)),
kinds AS (SELECT *, CASE WHEN w <= 24 AND h <= 24 THEN 'small_form_control' WHEN greatest(w, 0) * greatest(h, 0) / (612.0 * 792.0) >= 0.95 THEN 'full_page_scan' WHEN digest IS NULL THEN 'unrecoverable_image_block' ELSE 'embedded_raster' END AS kind FROM blocks),
placed AS (SELECT *, (row_number() OVER (PARTITION BY bundle_id, page_number ORDER BY bbox IS NULL, bbox[2], bbox[1], bbox[4], bbox[3], block_seq))::INT AS page_image_index FROM kinds),
named AS (SELECT *, CASE WHEN kind = 'embedded_raster' THEN 'derived/assets/' || first_value(printf('page-%04d-image-%03d.png', page_number, page_image_index)) OVER (PARTITION BY bundle_id, digest, kind = 'embedded_raster' ORDER BY page_number, page_image_index) END AS asset_path FROM placed)"""
PROFILES = """scans AS (SELECT bundle_id, page_number, bool_or(kind = 'full_page_scan') AS scan FROM kinds GROUP BY ALL),
profiles AS (SELECT l.*, coalesce(scan, false) AS scan, list_filter([CASE WHEN annotation_count >= 8 THEN 'fillable_form' END, CASE WHEN char_count >= 1800 THEN 'dense_text' END, CASE WHEN control_character_count > 0 THEN 'noisy_text_layer' END, CASE WHEN scan THEN 'full_page_scan' END, CASE WHEN has_text THEN 'text_layer_present' ELSE 'ocr_primary' END], lambda x: x IS NOT NULL) AS page_profile,
    has_text AND (char_count >= 80 OR annotation_count >= 8) AS attach, greatest(300, CASE WHEN scan THEN 400 ELSE 0 END, CASE WHEN annotation_count >= 40 THEN 450 ELSE 0 END) AS effective_dpi FROM layers l LEFT JOIN scans USING (bundle_id, page_number))"""
RESULTS = """results AS (SELECT doc_id, doc_id // 10 AS bundle_id, (doc_id % 10 + 1)::INT AS page_number, CASE WHEN doc_id % 41 = 0 THEN 'error' ELSE 'ok' END AS status, doc_id % 5 <> 0 AS m1, doc_id % 6 = 0 AS dpi400, doc_id % 37 = 0 AS cut, doc_id % 2 = 0 AS has_image,
    coalesce(text, '') AS head, CASE WHEN doc_id % 7 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS most FROM documents WHERE doc_id % 31 <> 0)"""
#: A result's Markdown after its placeholders are made canonical.
MD = r"""(head || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '<!-- IMAGE 002 -->' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '![A \[1](<../derived/assets/a.png>)' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '<!-- IMAGE 003 -->' ELSE '' END)"""
COMPLETE = "counts AS (SELECT doc_id // 10 AS bundle_id, count(*) AS page_count FROM documents GROUP BY ALL), complete AS (SELECT bundle_id FROM results JOIN counts USING (bundle_id) GROUP BY bundle_id, page_count HAVING count(*) = page_count AND bool_and(status = 'ok'))"
DOCS = f"docs AS (SELECT bundle_id, string_agg(printf('<!-- PAGE %04d -->', page_number) || chr(10) || chr(10) || regexp_replace({MD}, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY page_number) || chr(10) AS document FROM results JOIN complete USING (bundle_id) GROUP BY bundle_id)"


def query(f):
    Q[f.__name__] = f
    return f


def _images(spark, sf):
    return P.assign_assets(P.index_images(P.classify_images(I.image_blocks(spark, sf))))


def _profiles(spark, sf):
    return P.render_plan(P.page_profile(P.text_layers(I.page_text(spark, sf)), P.classify_images(I.image_blocks(spark, sf))))


@query
def str7_str8_text_layers(spark, sf):
    return P.text_layers(I.page_text(spark, sf))


SQL["str7_str8_text_layers"] = f"WITH {PAGE_TEXT}, {LAYERS} SELECT * EXCLUDE (doc_id) FROM layers"


@query
def prj9_classify_images(spark, sf):
    return P.classify_images(I.image_blocks(spark, sf)).select(*P.KEYS, "block_seq", "kind", "extractable", F.size("notes").alias("n_notes"))


SQL["prj9_classify_images"] = f"WITH {BLOCKS} SELECT bundle_id, page_number, block_seq, kind, kind = 'embedded_raster' AS extractable, (kind <> 'embedded_raster')::INT AS n_notes FROM kinds"


@query
def win5_index_images(spark, sf):
    return P.index_images(I.image_blocks(spark, sf)).select(*P.KEYS, "block_seq", "page_image_index")


SQL["win5_index_images"] = f"WITH {BLOCKS} SELECT bundle_id, page_number, block_seq, page_image_index FROM placed"


@query
def win6_assign_assets(spark, sf):
    return _images(spark, sf).select(*P.KEYS, "page_image_index", "asset_path")


SQL["win6_assign_assets"] = f"WITH {BLOCKS} SELECT bundle_id, page_number, page_image_index, asset_path FROM named"


@query
def prj7_page_profile(spark, sf):
    return _profiles(spark, sf).select(*P.KEYS, "page_profile")


SQL["prj7_page_profile"] = f"WITH {PAGE_TEXT}, {LAYERS}, {BLOCKS}, {PROFILES} SELECT bundle_id, page_number, page_profile FROM profiles"


@query
def prj8_render_plan(spark, sf):
    return _profiles(spark, sf).select(*P.KEYS, "attach", "effective_dpi")


SQL["prj8_render_plan"] = f"WITH {PAGE_TEXT}, {LAYERS}, {BLOCKS}, {PROFILES} SELECT bundle_id, page_number, attach, effective_dpi FROM profiles"


@query
def prj20_page_prompts(spark, sf):
    # A prompt lists the images that have an asset, by number and path; no others are named or gathered.
    linked = P.assign_assets(P.index_images(P.classify_images(I.image_blocks(spark, sf))).where("extractable"))
    images = P.images_by_page(linked, ["page_image_index", "asset_path"])
    return P.page_prompts(_profiles(spark, sf).join(images, P.KEYS, "left"), "BASE", SECTIONS).select(*P.KEYS, "page_prompt_sha256")


SQL["prj20_page_prompts"] = f"""WITH {PAGE_TEXT}, {LAYERS}, {BLOCKS}, {PROFILES},
lists AS (SELECT bundle_id, page_number, string_agg(printf('- `![IMAGE %03d](<../%s>)`', page_image_index, asset_path), chr(10) ORDER BY page_image_index) AS listed FROM named WHERE asset_path IS NOT NULL GROUP BY ALL)
SELECT bundle_id, page_number, sha256('BASE' || CASE WHEN annotation_count >= 8 THEN chr(10) || chr(10) || 'FORM' ELSE '' END || CASE WHEN scan THEN chr(10) || chr(10) || 'SCAN' ELSE '' END || CASE WHEN listed IS NOT NULL THEN chr(10) || chr(10) || 'IMAGES' || chr(10) || listed || chr(10) || 'MORE' ELSE '' END
  || CASE WHEN attach THEN chr(10) || chr(10) || 'LAYER' || chr(10) || '```text' || chr(10) || prompt_text || chr(10) || '```' ELSE '' END) AS page_prompt_sha256 FROM profiles LEFT JOIN lists USING (bundle_id, page_number)"""


@query
def prj3_expand_pages(spark, sf):
    e = I.extractions(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 == 0, "x").when(F.col("doc_id") % 10 == 0, "12").when(F.col("doc_id") % 11 == 0, " 2-4,,3,8-20").otherwise("1-3,7").alias("spec"), "page_count")
    return P.expand_pages(e, "doc_id", "spec", "page_count")


SQL["prj3_expand_pages"] = """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN []::INT[] WHEN doc_id % 10 = 0 THEN []::INT[] WHEN doc_id % 11 = 0 THEN [2, 3, 4, 8, 9] ELSE [1, 2, 3, 7] END AS pages FROM documents)
SELECT doc_id, unnest(CASE WHEN len(pages) = 0 THEN [NULL] ELSE pages END)::INT AS page_number, CASE WHEN doc_id % 9 = 0 THEN 'invalid page selection' WHEN len(pages) = 0 THEN 'no pages selected' END AS error FROM p"""


@query
def prj3_expand_pages_strict(spark, sf):
    e = I.extractions(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 == 0, "3-1").when(F.col("doc_id") % 10 == 0, "1,,2").when(F.col("doc_id") % 11 == 0, "0").otherwise("2,1-3").alias("spec"))
    return P.expand_pages(e, "doc_id", "spec", strict=True)


SQL["prj3_expand_pages_strict"] = "SELECT doc_id, unnest(CASE WHEN bad THEN [NULL] ELSE [1, 2, 3] END)::INT AS page_number, CASE WHEN bad THEN 'invalid page selection' END AS error FROM (SELECT doc_id, doc_id % 9 = 0 OR doc_id % 10 = 0 OR doc_id % 11 = 0 AS bad FROM documents)"


@query
def prj10_completeness_gate(spark, sf):
    return P.completeness_gate(I.extractions(spark, sf)).select("doc_id", "reasons", "status", "output")


SQL["prj10_completeness_gate"] = """WITH e AS (SELECT doc_id, ['text_based', 'mixed', 'scanned', 'image_based', 'text_based'][doc_id % 5 + 1] AS kind, CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '2,7' ELSE '2,7' END WHEN doc_id % 7 = 1 AND doc_id % 2 = 1 THEN '5' END AS pages, doc_id % 8 = 0 AS blank, CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE text END AS md FROM documents),
r AS (SELECT *, list_filter([CASE WHEN kind IN ('scanned', 'image_based') THEN 'PDF type is ' || kind END, CASE WHEN blank OR trim(md) = '' THEN 'backend returned no Markdown' END, 'pages need OCR: ' || pages, CASE WHEN doc_id % 11 = 0 THEN 'backend detected broken font encodings' END], lambda x: x IS NOT NULL) AS reasons FROM e),
s AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'ok' WHEN doc_id % 3 = 0 AND NOT blank THEN 'partial' ELSE 'blocked' END AS status FROM r)
SELECT doc_id, reasons, status, CASE status WHEN 'ok' THEN md WHEN 'partial' THEN '<!-- Partial pdf-inspector extraction: ' || array_to_string(reasons, '; ') || ' -->' || chr(10) || chr(10) || md END AS output FROM s"""


@query
def prj11_contract_check(spark, sf):
    e = I.extractions(spark, sf).select("doc_id", F.when(F.col("doc_id") % 6 == 0, '{"pdf_type": 1, "page_count": true}').when(F.col("doc_id") % 6 == 1, "not json").otherwise('{"pdf_type": "a", "page_count": 3, "pages_needing_ocr": [], "has_encoding_issues": false}').alias("j"))
    return P.contract_check(e, "j", {"pdf_type": "string", "page_count": "integer", "pages_needing_ocr": "array", "has_encoding_issues": "boolean"}).select("doc_id", "invalid_fields")


SQL["prj11_contract_check"] = "SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN ['has_encoding_issues', 'page_count', 'pages_needing_ocr', 'pdf_type'] ELSE []::VARCHAR[] END AS invalid_fields FROM documents"


@query
def prj14_ocr_text(spark, sf):
    t = F.coalesce("text", F.lit(""))
    choice = lambda reason, content: F.to_json(F.struct(F.array(F.struct(F.lit(reason).alias("finish_reason"), F.struct(content.alias("content")).alias("message"))).alias("choices")))
    parts = F.array(F.struct(F.lit("text").alias("type"), t.alias("text")), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(" end ").alias("text")))
    i = F.col("doc_id") % 5
    d = I.table(spark, sf, "documents").select("doc_id", F.when(i == 0, '{"choices": []}').when(i == 1, choice("length", t)).when(i == 2, choice("stop", parts)).when(i == 3, choice("stop", F.lit(None).cast("string"))).otherwise(choice("stop", F.concat(F.lit(" "), t, F.lit("\n")))).alias("response"))
    return P.ocr_text(d).select("doc_id", "text", "finish_reason", "error")


SQL["prj14_ocr_text"] = r"""SELECT doc_id, CASE i WHEN 2 THEN regexp_replace(t || chr(10) || ' end ', '^\s+|\s+$', '', 'g') WHEN 4 THEN regexp_replace(t, '^\s+|\s+$', '', 'g') END AS text, CASE WHEN i = 1 THEN 'length' WHEN i > 1 THEN 'stop' END AS finish_reason,
  CASE i WHEN 0 THEN 'no choices' WHEN 1 THEN 'truncated: length' WHEN 3 THEN 'no usable text' END AS error FROM (SELECT doc_id, doc_id % 5 AS i, coalesce(text, '') AS t FROM documents)"""


@query
def prj19_bundle_metadata(spark, sf):
    return P.bundle_metadata(I.bundles(spark, sf))


SQL["prj19_bundle_metadata"] = """WITH b AS (SELECT DISTINCT doc_id // 10 AS b FROM documents), s AS (SELECT b, CASE WHEN b % 2 = 0 THEN 'été-no-' || b WHEN b % 4 = 1 THEN 'file-' || b ELSE 'my-bundle-' || b END AS slug FROM b)
SELECT b AS bundle_id, slug AS bundle_slug, CASE WHEN b % 3 = 0 THEN 'id' ELSE slug END AS source_id, CASE WHEN b % 5 = 0 THEN 'Title' WHEN b % 4 = 1 THEN '--File_' || b ELSE 'my bundle ' || b END AS title, 'local://' || slug AS url FROM s"""


@query
def prj21_review_notes(spark, sf):
    r = I.page_results(spark, sf)
    reconciled = P.reconcile_images("images", "ocr_markdown")
    rows = r.withColumn("note", reconciled["note"]).withColumn("error", F.when(F.col("status") == "error", "failed")).select(*P.KEYS, "note", "error")
    return P.review_notes(rows.join(_profiles(spark, sf), P.KEYS)).select(*P.KEYS, "review_notes")


SQL["prj21_review_notes"] = f"""WITH {PAGE_TEXT}, {LAYERS}, {BLOCKS}, {PROFILES}, {RESULTS}
SELECT bundle_id, page_number, list_filter([CASE WHEN control_character_count > 0 AND attach THEN 'Embedded text layer held control characters: 1, 7' END,
  CASE WHEN has_image AND most < 1 THEN 'OCR output referenced 0 image placeholders but 1 visible image blocks were detected on the page.' END, CASE WHEN status = 'error' THEN 'failed' END], lambda x: x IS NOT NULL) AS review_notes FROM results JOIN profiles USING (bundle_id, page_number)"""


@query
def str12_normalize_placeholders(spark, sf):
    return I.page_results(spark, sf).select(*P.KEYS, X.normalize_placeholders("ocr_markdown").alias("markdown"))


SQL["str12_normalize_placeholders"] = f"WITH {RESULTS} SELECT bundle_id, page_number, {MD} AS markdown FROM results"


@query
def str13_image_numbers(spark, sf):
    return I.page_results(spark, sf).select(*P.KEYS, F.array_sort(X.image_numbers("ocr_markdown")).alias("numbers"))


SQL["str13_image_numbers"] = f"WITH {RESULTS} SELECT bundle_id, page_number, list_filter([CASE WHEN doc_id % 4 = 0 THEN 1 END, CASE WHEN doc_id % 3 = 0 THEN 2 END, CASE WHEN doc_id % 7 = 0 THEN 3 END], lambda x: x IS NOT NULL) AS numbers FROM results"


@query
def str14_reconcile_images(spark, sf):
    r = P.reconcile_images("images", "ocr_markdown")
    return I.page_results(spark, sf).select(*P.KEYS, F.size(r["images"]).alias("n"), F.transform(r["images"], lambda i: i["kind"]).alias("kinds"), r["note"].alias("note"))


SQL["str14_reconcile_images"] = f"""WITH {RESULTS}, n AS (SELECT *, has_image::INT AS own FROM results)
SELECT bundle_id, page_number, greatest(own, most)::INT AS n, list_concat(CASE WHEN has_image THEN ['embedded_raster'] ELSE [] END, list_transform(range(own, most), lambda i: 'ocr_placeholder_only')) AS kinds,
  CASE WHEN own > most THEN 'OCR output referenced 0 image placeholders but 1 visible image blocks were detected on the page.' END AS note FROM n"""


@query
def str15_split_pages(spark, sf):
    return P.split_pages(P.canonical_documents(I.bundles(spark, sf), I.page_results(spark, sf)))


SQL["str15_split_pages"] = rf"WITH {RESULTS}, {COMPLETE} SELECT bundle_id, page_number, regexp_replace({MD}, '^\s+|\s+$', '', 'g') AS text FROM results JOIN complete USING (bundle_id)"


@query
def agg3_canonical_documents(spark, sf):
    return P.canonical_documents(I.bundles(spark, sf), I.page_results(spark, sf))


SQL["agg3_canonical_documents"] = f"WITH {RESULTS}, {COMPLETE}, {DOCS} SELECT bundle_id, document FROM docs"


@query
def agg4_run_trace(spark, sf):
    pages = _profiles(spark, sf).join(I.page_results(spark, sf).select(*P.KEYS, "status"), P.KEYS, "left")
    return P.run_trace(pages, _images(spark, sf))


SQL["agg4_run_trace"] = f"""WITH {PAGE_TEXT}, {LAYERS}, {BLOCKS}, {PROFILES}, {RESULTS},
sides AS (SELECT bundle_id, page_number, bool_or(asset_path IS NOT NULL) AS assets, bool_or(kind <> 'embedded_raster') AS lost FROM named GROUP BY ALL),
p AS (SELECT p.bundle_id, p.page_number, r.status, assets, lost, has_text, annotation_count >= 8 AS form, effective_dpi > 300 AS high FROM profiles p LEFT JOIN results r USING (bundle_id, page_number) LEFT JOIN sides USING (bundle_id, page_number))
SELECT bundle_id, count(*) AS pages, count_if(status = 'ok') AS ok_pages, {', '.join(f"coalesce(list(page_number ORDER BY page_number) FILTER ({c}), []) AS {n}" for c, n in (("assets", "pages_with_assets"), ("lost", "pages_with_lost_images"), ("has_text", "pages_with_text_layer"), ("form", "form_pages"), ("high", "elevated_dpi_pages")))} FROM p GROUP BY bundle_id"""


@query
def agg15_validate_bundles(spark, sf):
    b, r = I.bundles(spark, sf), I.page_results(spark, sf)
    return P.validate_bundles(b, r, P.canonical_documents(b, r))


SQL["agg15_validate_bundles"] = f"""WITH {RESULTS}, {COMPLETE}
SELECT bundle_id, coalesce(count(r.doc_id) = page_count AND bool_and(status = 'ok'), false) AS pages_ok, coalesce(NOT bool_or(cut), false) AS none_truncated, bundle_id IN (SELECT bundle_id FROM complete) AS markers_in_order,
  coalesce(bool_and(most <= has_image::INT), false) AS images_match, count(r.doc_id) > 0 AS checksum_matches FROM counts LEFT JOIN results r USING (bundle_id) GROUP BY bundle_id, page_count"""


@query
def join2_reusable_pages(spark, sf):
    wanted = I.page_text(spark, sf).select(*P.KEYS, F.lit("m1").alias("model"), F.sha2((F.col("bundle_id") * 10 + F.col("page_number") - 1).cast("string"), 256).alias("page_prompt_sha256"), F.lit(300).alias("dpi"), F.sha2(F.col("bundle_id").cast("string"), 256).alias("source_pdf_sha256"), F.lit("image/png").alias("render_media_type"), F.lit("auto").alias("ocr_mode"))
    return P.reusable_pages(wanted, I.page_results(spark, sf), save_renders=True)


SQL["join2_reusable_pages"] = f"""WITH {RESULTS}, kept AS (SELECT bundle_id, page_number, status, CASE WHEN m1 THEN 'm1' ELSE 'm0' END AS model, CASE WHEN dpi400 THEN 400 ELSE 300 END AS dpi, sha256(doc_id::VARCHAR) AS prompt, sha256((doc_id // 10)::VARCHAR) AS source, CASE WHEN doc_id % 2 = 0 THEN 'derived/renders/a.png' END AS render FROM results),
wanted AS (SELECT doc_id // 10 AS bundle_id, (doc_id % 10 + 1)::INT AS page_number, 'm1' AS model, sha256(doc_id::VARCHAR) AS prompt, 300 AS dpi, sha256((doc_id // 10)::VARCHAR) AS source FROM documents)
SELECT bundle_id, page_number FROM wanted w JOIN kept k USING (bundle_id, page_number) WHERE status = 'ok' AND k.model = w.model AND k.prompt = w.prompt AND k.dpi = w.dpi AND k.source = w.source AND render IS NOT NULL"""


@query
def join1_pending_pages(spark, sf):
    return lectures.pending(I.page_text(spark, sf).select(*P.KEYS), I.page_results(spark, sf).where("status = 'ok'"), P.KEYS)


SQL["join1_pending_pages"] = f"WITH {RESULTS} SELECT doc_id // 10 AS bundle_id, (doc_id % 10 + 1)::INT AS page_number FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM results WHERE status = 'ok')"


@query
def join9_checksums(spark, sf):
    b = I.bundles(spark, sf)
    sources = b.where("bundle_id % 6 <> 0").select("bundle_id", F.when(F.col("bundle_id") % 4 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return P.checksum_mismatches(sources, b)


SQL["join9_checksums"] = "SELECT DISTINCT doc_id // 10 AS bundle_id, CASE WHEN doc_id // 10 % 6 = 0 THEN 'missing' ELSE 'different' END AS problem FROM documents WHERE doc_id // 10 % 6 = 0 OR doc_id // 10 % 4 = 0"


@query
def set1_all_results(spark, sf):
    r = I.page_results(spark, sf)
    errors = r.where("status = 'error'").select(*P.KEYS, "status", F.lit("failed").alias("error"))
    return P.all_results(r.where("status = 'ok'").select(*P.KEYS, "status", "model"), errors)


SQL["set1_all_results"] = f"WITH {RESULTS} SELECT bundle_id, page_number, status, CASE WHEN status = 'ok' THEN CASE WHEN m1 THEN 'm1' ELSE 'm0' END END AS model, CASE WHEN status = 'error' THEN 'failed' END AS error FROM results"


@query
def set2_blocked_pages(spark, sf):
    e = I.extractions(spark, sf)
    return P.blocked_pages(e.select("doc_id", F.explode("pages_needing_ocr").alias("page_number")), P.expand_pages(e.where("selection is not null"), "doc_id", "selection", "page_count").select("doc_id", "page_number"))


SQL["set2_blocked_pages"] = """WITH needing AS (SELECT doc_id, unnest(CASE doc_id % 7 WHEN 0 THEN [7, 2] WHEN 1 THEN [5] ELSE []::INT[] END)::INT AS page_number FROM documents),
ranges AS (SELECT doc_id, string_split(unnest(string_split('1-3,7', ',')), '-') AS p FROM documents WHERE doc_id % 2 = 0), chosen AS (SELECT doc_id, unnest(range(p[1]::INT, p[-1]::INT + 1))::INT AS page_number FROM ranges)
SELECT * FROM needing INTERSECT SELECT * FROM chosen"""


@query
def str9_str10_str11_names(spark, sf):
    d = I.table(spark, sf, "documents")
    name = F.coalesce("text", F.lit(""))
    return d.select("doc_id", X.slugify(name).alias("slug"), X.safe_filename(name).alias("file"), X.sanitize_ext(F.when(F.col("doc_id") % 3 == 0, ".J-P+G").otherwise("...")).alias("ext"))


SQL["str9_str10_str11_names"] = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'pdf-bundle') AS slug, coalesce(nullif(trim(regexp_replace(t, '[^\p{L}\p{N}_ .-]', '_', 'g'), ' .'), ''), 'lecture') AS file, CASE WHEN doc_id % 3 = 0 THEN 'jpg' ELSE 'bin' END AS ext FROM d"""


@query
def str18_paths(spark, sf):
    return I.page_text(spark, sf).select(*P.KEYS, X.page_file("page_number").alias("json"), X.image_file("page_number", "annotation_count", F.lit("png")).alias("image"), X.media_type(F.when(F.col("page_number") % 3 == 0, "png").when(F.col("page_number") % 3 == 1, "jpeg").otherwise("gif")).alias("media"))


SQL["str18_paths"] = f"WITH {PAGE_TEXT} SELECT bundle_id, page_number, printf('page-%04d.json', page_number) AS json, printf('page-%04d-image-%03d.png', page_number, annotation_count) AS image, CASE page_number % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' END AS media FROM page_text"


@query
def mth1_round_bbox(spark, sf):
    b = I.image_blocks(spark, sf)
    return b.select(*P.KEYS, "block_seq", X.round_bbox(F.transform("bbox", lambda x: x / 3)).alias("bbox"))


SQL["mth1_round_bbox"] = f"WITH {BLOCKS} SELECT bundle_id, page_number, block_seq, list_transform(bbox, lambda x: round(x / 3, 2)) AS bbox FROM blocks"


@query
def arr1_array_operations(spark, sf):
    w, half = X.tokens(F.coalesce("text", F.lit(""))), F.floor(F.size("w") / 2).cast("int")
    d = I.table(spark, sf, "documents").select("doc_id", w.alias("w"))
    return d.select("doc_id", F.slice("w", 1, 2).alias("head"), F.array_sort(F.array_distinct(F.transform("w", F.length))).alias("sizes"), F.size(F.array_intersect(F.slice("w", F.lit(1), half), F.slice("w", half + 1, F.size("w")))).alias("common"), F.array_contains("w", "the").alias("has_the"))


SQL["arr1_array_operations"] = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, w[1:2] AS head, list_sort(list_distinct(list_transform(w, lambda x: length(x)::INT))) AS sizes, len(list_intersect(w[1:len(w) // 2], w[len(w) // 2 + 1:]))::INT AS common, list_contains(w, 'the') AS has_the FROM d"""
