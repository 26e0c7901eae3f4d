"""Page OCR bundles: text layers, images, prompts, cached results, complete documents, traces; and the gate for extracted text."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

KEYS = ["bundle_id", "page_number"]
#: Thresholds of page profiles and renders.
FORM_ANNOTATIONS, DENSE_CHARS, LAYER_CHARS, DENSE_FORM_ANNOTATIONS, SCAN_DPI, FORM_DPI = 8, 1800, 80, 40, 400, 450
#: Limits of image blocks: a control's sides, and the share of the page that makes a scan.
CONTROL_SIDE, SCAN_SHARE = 24.0, 0.95
TRUNCATED = ("length", "max_tokens")
NOTES = {
    "small_form_control": "Tiny repeated control icon ignored for image-linking and placeholder reconciliation.",
    "full_page_scan": "Image occupies most of the page and is treated as the page scan, not a linkable figure asset.",
    "unrecoverable_image_block": "Visible image block had no recoverable binary payload.",
}
PLACEHOLDER_NOTE = "OCR output referenced a figure without a separately extracted asset."
CHOICES = T.StructType([T.StructField("choices", T.ArrayType(T.StructType([T.StructField("finish_reason", T.StringType()), T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))])))])
PARTS = "array<struct<type string, text string>>"


def expand_pages(selections: DataFrame, key: str, spec_col: str, page_count_col: str | None = None, strict: bool = False) -> DataFrame:
    """key, page_number, error: a row for each page of selections such as 1-3,7, or one row with an error.

    Lenient: blank parts are skipped and pages outside 1..page_count dropped; none left is an error. Strict:
    a blank part, no number, a number below 1 or a reversed range is an error.
    """
    part = F.split(F.col(spec_col), ",")
    parts = F.transform(part, lambda x: F.trim(x))
    wanted = parts if strict else F.filter(parts, lambda x: x != "")
    range_ = r"^\s*(\d+)\s*(?:-\s*(\d+))?\s*$"
    ends = F.transform(wanted, lambda x: F.struct(F.regexp_extract(x, range_, 1).try_cast("int").alias("a"), F.coalesce(F.nullif(F.regexp_extract(x, range_, 2), F.lit("")), F.regexp_extract(x, range_, 1)).try_cast("int").alias("b")))
    broken = F.exists("ends", lambda e: e["a"].isNull() | e["b"].isNull() | ((e["a"] < 1) | (e["b"] < e["a"]) if strict else F.lit(False)))
    row = selections.select(key, *([page_count_col] if page_count_col else []), F.col(spec_col).alias("__spec"), ends.alias("ends"))
    top = F.col(page_count_col) if page_count_col else F.lit(2**31 - 1)
    low, high = (lambda e: F.greatest(e["a"], F.lit(1))), (lambda e: F.least(e["b"], top) if page_count_col else e["b"])
    good = F.filter("ends", lambda e: low(e) <= high(e))  # a sequence of a reversed range would count down
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda e: F.sequence(low(e), high(e))))))
    error = F.when(F.col("__spec").isNull() | broken, F.lit("invalid page selection")).when(F.size(pages) == 0, F.lit("no pages selected"))
    marked = row.select(key, pages.alias("pages"), error.alias("error"))
    return marked.select(key, F.explode_outer(F.when(F.col("error").isNull(), F.col("pages"))).alias("page_number"), "error")


def text_layers(page_text: DataFrame) -> DataFrame:
    return page_text.select(*KEYS, F.coalesce("annotation_count", F.lit(0)).alias("annotation_count"), *(c.alias(n) for n, c in X.text_layer("raw_text").items()))


def classify_images(blocks: DataFrame) -> DataFrame:
    """Adds kind, extractable and notes."""
    side = lambda a, b: F.coalesce(F.try_element_at("bbox", F.lit(b)) - F.try_element_at("bbox", F.lit(a)), F.lit(0.0))
    width, height = side(1, 3), side(2, 4)
    share = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0)) / F.greatest(F.col("page_width") * F.col("page_height"), F.lit(1.0))
    kind = F.when((width <= CONTROL_SIDE) & (height <= CONTROL_SIDE), "small_form_control").when(share >= SCAN_SHARE, "full_page_scan").when(F.col("digest").isNull(), "unrecoverable_image_block").otherwise("embedded_raster")
    notes = F.array_compact(F.array(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in NOTES.items())))
    return blocks.withColumn("kind", kind).withColumn("extractable", F.col("kind") == "embedded_raster").withColumn("notes", notes)


def index_images(blocks: DataFrame) -> DataFrame:
    """Adds page_image_index: from top to bottom, boxes without four numbers last, ties by block_seq."""
    whole = F.coalesce(F.size("bbox") == 4, F.lit(False))
    at = [F.when(whole, F.try_element_at("bbox", F.lit(i))) for i in (2, 1, 4, 3)]
    order = Window.partitionBy(*KEYS).orderBy(*(c.asc_nulls_last() for c in at), "block_seq")
    return blocks.withColumn("page_image_index", F.row_number().over(order))


def assign_assets(images: DataFrame) -> DataFrame:
    """Adds asset_path: equal bytes in a bundle are one asset, named by its first page and index. Only digests are shuffled, never bytes."""
    own = Window.partitionBy("bundle_id", F.when(F.col("extractable"), F.col("digest")), "extractable").orderBy("page_number", "page_image_index")
    first = F.first(F.struct("page_number", "page_image_index", "ext")).over(own)
    name = X.image_file(F.col("__f.page_number"), F.col("__f.page_image_index"), X.sanitize_ext("__f.ext"))
    return images.withColumn("__f", first).withColumn("asset_path", F.when(F.col("extractable"), F.concat(F.lit("derived/assets/"), name))).drop("__f")


IMAGE_FIELDS = ("page_image_index", "asset_path", "bbox", "extractable", "kind", "notes")


def images_by_page(images: DataFrame, fields: Sequence[str] = IMAGE_FIELDS) -> DataFrame:
    """Each page's images in order. Only the fields asked for are shuffled, here and in what numbers and names the images before."""
    return images.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("images"))


def page_profile(layers: DataFrame, images: DataFrame) -> DataFrame:
    """Adds page_profile, an ordered array of labels."""
    scans = images.groupBy(*KEYS).agg(F.bool_or(F.col("kind") == "full_page_scan").alias("__scan"))
    labels = F.array_compact(F.array(
        F.when(F.col("annotation_count") >= FORM_ANNOTATIONS, F.lit("fillable_form")),
        F.when(F.col("char_count") >= DENSE_CHARS, F.lit("dense_text")),
        F.when(F.col("control_character_count") > 0, F.lit("noisy_text_layer")),
        F.when(F.col("__scan"), F.lit("full_page_scan")),
        F.when(F.col("has_text"), F.lit("text_layer_present")).otherwise(F.lit("ocr_primary")),
    ))
    return layers.join(scans, KEYS, "left").withColumn("page_profile", labels).drop("__scan")


def attaches(mode: str) -> Column:
    if mode == "ocr":
        return F.lit(False)
    enough = F.lit(True) if mode == "hybrid" else (F.col("char_count") >= LAYER_CHARS) | (F.col("annotation_count") >= FORM_ANNOTATIONS)
    return F.col("has_text") & enough


def render_plan(profiles: DataFrame, mode: str = "auto", base_dpi: int = 300) -> DataFrame:
    """Adds attach and effective_dpi."""
    scan = F.when(F.array_contains("page_profile", "full_page_scan"), SCAN_DPI).otherwise(0)
    form = F.when(F.array_contains("page_profile", "fillable_form") & (F.col("annotation_count") >= DENSE_FORM_ANNOTATIONS), FORM_DPI).otherwise(0)
    return profiles.withColumn("attach", attaches(mode)).withColumn("effective_dpi", F.greatest(F.lit(base_dpi), scan, form))


def page_prompts(pages: DataFrame, base_prompt: str, sections: dict[str, str]) -> DataFrame:
    """Adds prompt and page_prompt_sha256.

    pages: page_profile, images, attach, prompt_text. sections: texts for form, scan, images, more_images and
    text_layer, each left out where it does not apply.
    """
    has = lambda label: F.array_contains("page_profile", label)
    extracted = F.filter(F.coalesce("images", F.array().cast(pages.schema["images"].dataType)), lambda i: i["asset_path"].isNotNull())
    number = lambda i: F.format_string("IMAGE %03d", i["page_image_index"])
    listed = F.transform(extracted, lambda i: F.concat(F.lit("- `"), X.markdown_image(number(i), i["asset_path"]), F.lit("`")))
    prompt = F.concat_ws("\n", F.lit(base_prompt), F.when(has("fillable_form"), F.lit("\n" + sections["form"])), F.when(has("full_page_scan"), F.lit("\n" + sections["scan"])), F.when(F.size(extracted) > 0, F.concat(F.lit("\n" + sections["images"] + "\n"), F.array_join(listed, "\n"), F.lit("\n" + sections["more_images"]))), F.when(F.col("attach"), F.concat(F.lit("\n" + sections["text_layer"] + "\n```text\n"), F.col("prompt_text"), F.lit("\n```"))))
    return pages.withColumn("prompt", prompt).withColumn("page_prompt_sha256", F.sha2("prompt", 256))


def ocr_text(responses: DataFrame, response: str = "response") -> DataFrame:
    """Adds text, finish_reason and error of a provider's JSON response."""
    choice = F.try_element_at(F.from_json(response, CHOICES)["choices"], F.lit(1))
    content = choice["message"]["content"]
    listed = F.from_json(content, PARTS)
    parts = F.filter(F.transform(F.filter(listed, lambda p: p["type"] == "text"), lambda p: p["text"]), lambda t: t.rlike(r"\S"))
    joined = F.nullif(F.regexp_replace(F.array_join(parts, "\n"), r"(?U)^\s+|\s+$", ""), F.lit(""))
    is_list = content.rlike(r"^\s*\[\s*\{")
    text = F.when(is_list & listed.isNotNull(), joined).otherwise(F.regexp_replace(content, r"(?U)^\s+|\s+$", ""))
    reason = choice["finish_reason"]
    error = F.when(choice.isNull(), F.lit("no choices")).when(reason.isin(*TRUNCATED), F.concat(F.lit("truncated: "), reason)).when(text.isNull(), F.lit("no usable text"))
    return responses.withColumn("finish_reason", reason).withColumn("error", error).withColumn("text", F.when(error.isNull(), text))


def reconcile_images(images: Column | str, markdown: Column | str) -> dict[str, Column]:
    """images with rows for references beyond them, and note (null where there is none)."""
    images, most = X.col(images), F.coalesce(F.array_max(X.image_numbers(markdown)), F.lit(0))
    n = F.size(images)
    extra = F.transform(F.sequence(n + 1, F.greatest(most, n + 1)), lambda i: F.struct(i.alias("page_image_index"), F.lit(None).cast("string").alias("asset_path"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(False).alias("extractable"), F.lit("ocr_placeholder_only").alias("kind"), F.array(F.lit(PLACEHOLDER_NOTE)).alias("notes")))
    some = F.exists(images, lambda i: i["asset_path"].isNotNull())
    note = F.when((n > most) & some, F.format_string("OCR output referenced %d image placeholders but %d visible image blocks were detected on the page.", most, n))
    return {"images": F.when(most > n, F.concat(images, extra)).otherwise(images), "note": note}


def review_notes(pages: DataFrame) -> DataFrame:
    """Adds review_notes from control_character_codes, attach, note and error."""
    codes = F.array_join(F.transform("control_character_codes", lambda c: c.cast("string")), ", ")
    noisy = F.when((F.size("control_character_codes") > 0) & F.col("attach"), F.concat(F.lit("Embedded text layer held control characters: "), codes))
    return pages.withColumn("review_notes", F.array_compact(F.array(noisy, F.col("note"), F.col("error"))))


def reusable_pages(requested: DataFrame, results: DataFrame, save_renders: bool = False) -> DataFrame:
    """Stored results that may stand for a request: all that decided the page is the same. Only the columns compared are shuffled."""
    same = ["model", "page_prompt_sha256", "source_pdf_sha256", "render_media_type", "ocr_mode"]
    kept = results.where((F.col("status") == "ok") & (F.col("source_pdf_path") == "raw/source.pdf") & F.col("render_dimensions").isNotNull() & F.col("render_sha256").isNotNull())
    if save_renders:
        kept = kept.where("rendered_image_path is not null")
    kept = kept.select(*KEYS, F.col("dpi").try_cast("int").alias("__dpi"), *(F.col(c).alias(f"__{c}") for c in same))
    joined = requested.join(kept, KEYS).where(F.col("dpi") == F.col("__dpi"))
    for c in same:
        joined = joined.where(F.col(c) == F.col(f"__{c}"))
    return joined.select(*KEYS)


def all_results(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


#: Where a page begins: four digits, and more from page 10,000 on. What looks like it inside a page's text gets a backslash in the document.
MARK = r"<!-- PAGE (\d{4,}) -->"
_HIDE = (r"<!-- (\\*)PAGE (\d{4,}) -->", r"<!-- $1\\PAGE $2 -->")
_SHOW = (r"<!-- (\\*)\\PAGE (\d{4,}) -->", r"<!-- $1PAGE $2 -->")


def canonical_documents(bundles: DataFrame, results: DataFrame) -> DataFrame:
    """bundle_id and document of each bundle all of whose pages are there and ok. Completeness is counted first, so the texts of other bundles are not gathered."""
    good = results.groupBy("bundle_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"))
    complete = bundles.select("bundle_id", "page_count").join(good, "bundle_id").where("n = page_count and ok = n").select("bundle_id")
    body = F.regexp_replace(X.normalize_placeholders(F.regexp_replace("ocr_markdown", r"(?U)^\s+|\s+$", "")), "^$", "")
    page = F.concat(F.format_string("<!-- PAGE %04d -->\n\n", "page_number"), F.regexp_replace(body, *_HIDE))
    pages = results.join(complete, "bundle_id", "left_semi").select("bundle_id", "page_number", page.alias("page"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page"))), lambda p: p["page"]), "\n\n")
    return pages.groupBy("bundle_id").agg(whole.alias("d")).select("bundle_id", F.concat(F.regexp_replace("d", r"(?U)^\s+|\s+$", ""), F.lit("\n")).alias("document"))


def split_pages(documents: DataFrame) -> DataFrame:
    """bundle_id, page_number and text of each page of a complete document: the inverse of canonical_documents, whatever the pages' numbers and texts."""
    mark = rf"{MARK}\n\n"
    numbers = F.transform(F.regexp_extract_all("document", F.lit(mark), F.lit(1)), lambda x: x.cast("int"))
    texts = F.slice(F.split("document", mark), 2, 1 << 30)
    rows = documents.select("bundle_id", F.explode(F.arrays_zip(numbers.alias("page_number"), texts.alias("text"))).alias("x"))
    return rows.select("bundle_id", F.col("x.page_number").alias("page_number"), F.regexp_replace(F.regexp_replace("x.text", r"\n{1,2}$", ""), *_SHOW).alias("text"))


def run_trace(pages: DataFrame, images: DataFrame, base_dpi: int = 300) -> DataFrame:
    """Per bundle sorted lists of pages with each trait, and counts."""
    sides = images.groupBy(*KEYS).agg(F.bool_or(F.col("asset_path").isNotNull()).alias("assets"), F.bool_or(~F.col("extractable")).alias("lost"))
    pages_where = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page_number"))))
    form = F.array_contains("page_profile", "fillable_form")
    return pages.join(sides, KEYS, "left").groupBy("bundle_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("status") == "ok").alias("ok_pages"),
        pages_where(F.col("assets")).alias("pages_with_assets"), pages_where(F.col("lost")).alias("pages_with_lost_images"),
        pages_where(F.col("has_text")).alias("pages_with_text_layer"), pages_where(form).alias("form_pages"), pages_where(F.col("effective_dpi") > base_dpi).alias("elevated_dpi_pages"),
    )


def validate_bundles(bundles: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """Per bundle a checklist: pages_ok, none_truncated, markers_in_order, images_match, checksum_matches."""
    per = results.groupBy("bundle_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("status") == "ok").alias("ok"), (~F.bool_or(F.coalesce(F.col("finish_reason").isin(*TRUNCATED), F.lit(False)))).alias("none_truncated"),
        F.bool_and(F.coalesce(F.array_max(X.image_numbers("ocr_markdown")), F.lit(0)) <= F.size("images")).alias("images_match"), F.bool_and(F.col("source_pdf_sha256").eqNullSafe(F.col("sha256"))).alias("checksum_matches"),
    ) if "sha256" in results.columns else None
    if per is None:
        return validate_bundles(bundles, results.join(bundles.select("bundle_id", "sha256"), "bundle_id"), documents)
    marks = F.transform(F.regexp_extract_all("document", F.lit(MARK), F.lit(1)), lambda x: x.cast("int"))
    docs = documents.select("bundle_id", marks.alias("marks"))
    joined = bundles.select("bundle_id", "page_count").join(per, "bundle_id", "left").join(docs, "bundle_id", "left")
    return joined.select("bundle_id", F.coalesce((F.col("n") == F.col("page_count")) & F.col("ok"), F.lit(False)).alias("pages_ok"), F.coalesce("none_truncated", F.lit(False)).alias("none_truncated"), F.coalesce(F.col("marks") == F.sequence(F.lit(1), F.col("page_count")), F.lit(False)).alias("markers_in_order"), F.coalesce("images_match", F.lit(False)).alias("images_match"), F.coalesce("checksum_matches", F.lit(False)).alias("checksum_matches"))


def bundle_metadata(bundles: DataFrame) -> DataFrame:
    """source_id, bundle_slug, title and url, each by its chain of defaults. Columns: slug, source_id, title, url (each may be null), file_stem, folder."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    slug = X.slugify(F.coalesce(given("slug"), given("file_stem"), F.col("folder")))
    title = F.coalesce(given("title"), given("file_stem"), F.replace(F.col("folder"), F.lit("-"), F.lit(" ")))
    return bundles.select("bundle_id", slug.alias("bundle_slug"), F.coalesce(given("source_id"), slug).alias("source_id"), title.alias("title"), F.coalesce(given("url"), F.concat(F.lit("local://"), slug)).alias("url"))


def checksum_mismatches(sources: DataFrame, bundles: DataFrame) -> DataFrame:
    joined = bundles.select("bundle_id", "sha256").join(sources.select("bundle_id", F.col("sha256").alias("found")), "bundle_id", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(~F.col("found").eqNullSafe(F.col("sha256")), "different")
    return joined.select("bundle_id", problem.alias("problem")).where("problem is not null")


def completeness_gate(extractions: DataFrame) -> DataFrame:
    """Adds reasons, status (ok, partial or blocked) and output, the Markdown that may be written."""
    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split("selection", ","), lambda x: F.sequence(F.regexp_extract(x, r"(\d+)", 1).cast("int"), F.regexp_extract(x, r"(\d+)\s*$", 1).cast("int"))))))
    needed = F.coalesce("pages_needing_ocr", F.array().cast("array<int>"))
    relevant = F.array_sort(F.array_distinct(F.when(F.col("selection").isNull(), needed).otherwise(F.array_intersect(needed, chosen))))
    has_text = F.coalesce(F.col("markdown").rlike(r"(?U)\S"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("pdf_type").isin("scanned", "image_based"), F.concat(F.lit("PDF type is "), F.col("pdf_type"))),
        F.when(~has_text, F.lit("backend returned no Markdown")),
        F.when(F.size(relevant) > 0, F.concat(F.lit("pages need OCR: "), F.array_join(F.transform(relevant, lambda p: p.cast("string")), ","))),
        F.when(F.col("has_encoding_issues"), F.lit("backend detected broken font encodings")),
    ))
    status = F.when(F.size("reasons") == 0, "ok").when(F.col("allow_partial") & has_text, "partial").otherwise("blocked")
    warning = F.concat(F.lit("<!-- Partial pdf-inspector extraction: "), F.array_join("reasons", "; "), F.lit(" -->\n\n"), F.col("markdown"))
    return extractions.withColumn("reasons", reasons).withColumn("status", status).withColumn("output", F.when(F.col("status") == "ok", F.col("markdown")).when(F.col("status") == "partial", warning))


def contract_check(df: DataFrame, json_col: str, required: dict[str, str]) -> DataFrame:
    """Adds invalid_fields: required keys that are missing or of another JSON type (string, integer, boolean, array or object)."""
    kinds = {"string": "^STRING$", "integer": "^BIGINT$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}
    value = F.try_parse_json(json_col)
    bad = [F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")).rlike(kinds[t]), F.lit(False)), F.lit(k)) for k, t in sorted(required.items())]
    return df.withColumn("invalid_fields", F.array_compact(F.array(*bad)))


def blocked_pages(needing: DataFrame, selected: DataFrame) -> DataFrame:
    return needing.intersect(selected)
