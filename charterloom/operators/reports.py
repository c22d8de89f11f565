"""Reports: aligned HTML, heatmap, summary and variant tables, and the similarity table itself."""

from __future__ import annotations

import html
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charterloom.operators import align
from charterloom.operators.similarity import dense_matrix

MAX_FILE_BYTES = 20 * 1024 * 1024
HEATMAP_LIMIT = 2000

_HEAD = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Text comparisons</title><style>
body{font-family:sans-serif}.pair{display:flex;gap:1em;border-bottom:1px solid #ccc}.text-box{flex:1}
.highlight,.match-text{background:#ffe9a8;cursor:pointer}.active{background:#ffc933}.is-similar{background:#cfe8cf}
.is-dissimilar{background:#f3cfcf}.plain .bridge-words span{background:none}</style></head><body>
<p>Score from <input id="lo" type="range" min="0" max="1" step="0.001" value="%(lo).4f"> to
<input id="hi" type="range" min="0" max="1" step="0.001" value="1">, word similarity
<input id="fz" type="range" min="0" max="1" step="0.01" value="%(fuzz).2f">
<label><input id="br" type="checkbox" checked> differing words</label></p>
"""
_TAIL = """<script>
const q=s=>document.getElementById(s), all=s=>document.querySelectorAll(s);
function range(){let a=+q('lo').value,b=+q('hi').value;if(b-a<0.001){b=Math.min(1,a+0.001);q('hi').value=b}
all('.pair').forEach(p=>{const s=+p.dataset.score;p.style.display=s>=a&&s<=b?'':'none'})}
function words(){const t=+q('fz').value;all('.dynamic-bridge-word').forEach(w=>{const s=+w.dataset.fuzz>=t;
w.classList.toggle('is-similar',s);w.classList.toggle('is-dissimilar',!s)})}
['lo','hi'].forEach(k=>q(k).addEventListener('input',range));q('fz').addEventListener('input',words);
q('br').addEventListener('change',e=>document.body.classList.toggle('plain',!e.target.checked));
document.addEventListener('click',e=>{const m=e.target.closest('[data-match-id]');if(!m)return;
all('.active').forEach(x=>x.classList.remove('active'));
all(`[data-pair-id="${m.dataset.pairId}"][data-match-id="${m.dataset.matchId}"]`).forEach(x=>{x.classList.add('active');
if(x!==m)x.scrollIntoView({block:'center',behavior:'smooth'})})});
</script></body></html>
"""


def _block(row) -> str:
    box = lambda name, body: f'<div class="text-box"><p class="file-info">{html.escape(name)}</p>{body}</div>'
    inner = box(row["name1"], row["html1"]) + box(row["name2"], row["html2"])
    return f'<div class="pair" data-score="{row["score"]:.4f}" data-pair-id="{row["i"]}-{row["j"]}"><p>{row["score"]:.4f}</p>{inner}</div>\n'


def split_pages(blocks: Iterator[str], most: int) -> Iterator[list[str]]:
    """Blocks in order, a new page where the next block would exceed ``most`` bytes; a page holds one block at least."""
    page, size = [], 0
    for block in blocks:
        n = len(block.encode("utf-8"))
        if page and size + n > most:
            yield page
            page, size = [], 0
        page.append(block)
        size += n
    if page:
        yield page


def write_comparison_html(pairs: DataFrame, docs: DataFrame, threshold: float, folder: str, max_gap: int = 5, fuzz: float = 0.75, most: int = MAX_FILE_BYTES) -> list[str]:
    """Aligned pairs by falling score as one or more files.  Rows stream to the driver; nothing is gathered at once."""
    rows = align.highlighted_pairs(pairs.where(F.col("score") >= threshold), docs, max_gap, fuzz).orderBy(F.desc("score"), "i", "j")
    paths = []
    for number, page in enumerate(split_pages(map(_block, rows.toLocalIterator()), most)):
        paths.append(os.path.join(folder, "text_comparisons.html" if not number else f"text_comparisons_{number + 1:02d}.html"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            f.write(_HEAD % {"lo": threshold, "fuzz": fuzz} + "".join(page) + _TAIL)
    return paths


def related_pairs(pairs: DataFrame, threshold: float, inter: bool = False, compat: bool = False) -> DataFrame:
    """(doc_idx, related): one row for each related document of a document, however many there are.

    ``compat`` leaves out pairs of equal index between two corpora, as the reference does.
    """
    kept = pairs.where(F.col("score") >= threshold).select(F.col("i").alias("doc_idx"), F.col("j").alias("related"))
    if not inter:
        kept = kept.where("doc_idx <> related")
        return kept.unionByName(kept.select(F.col("related").alias("doc_idx"), F.col("doc_idx").alias("related")))
    return kept.where("doc_idx <> related") if compat else kept


def related_documents(pairs: DataFrame, docs: DataFrame, threshold: float, inter: bool = False, compat: bool = False) -> DataFrame:
    """(doc_idx, name, n_related, related) for every document of corpus 1, names sorted, ``None`` where there are none.

    A report for readers: the names of one document are one string, made in one task.  ``related_pairs`` is the table.
    """
    kept = related_pairs(pairs, threshold, inter, compat).toDF("i", "j")
    names = docs.select(F.col("doc_idx").alias("j"), F.coalesce("name", F.lit("")).alias("other"))
    grouped = kept.join(names, "j").groupBy(F.col("i").alias("doc_idx")).agg(F.count("*").alias("n_related"), F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("related"))
    own = docs.where("corpus = 1").select("doc_idx", F.coalesce("name", F.lit("")).alias("name"))
    return own.join(grouped, "doc_idx", "left").select("doc_idx", "name", F.coalesce("n_related", F.lit(0)).alias("n_related"), F.coalesce("related", F.lit("None")).alias("related"))


def summary(pairs: DataFrame, docs: DataFrame, threshold: float, inter: bool = False) -> DataFrame:
    """(document_filename, similarity_frequency, related_documents, long_similarities), one row per document of corpus 1."""
    kept = pairs.where((F.col("score") >= threshold) & (F.col("i") != F.col("j"))).select("i", "j")
    directed = kept if inter else kept.unionByName(kept.select(F.col("j").alias("i"), F.col("i").alias("j")))
    segments = align.long_segments(directed, docs).groupBy("doc_idx").agg(F.collect_list("segment").alias("s"))
    longest = F.array_sort(F.transform("s", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    text = F.array_join(F.transform(longest, lambda x: F.concat(F.lit('"'), x["x"], F.lit('"'))), " | ")
    rows = related_documents(pairs, docs, threshold, inter).join(segments, "doc_idx", "left")
    return rows.select(
        "doc_idx", F.col("name").alias("document_filename"), F.col("n_related").alias("similarity_frequency"),
        F.col("related").alias("related_documents"), F.coalesce(text, F.lit("None")).alias("long_similarities"),
    )


def write_tsv(df: DataFrame, path: str, header: list[str], order: list[str], columns: list[str], single: bool = True) -> str:
    """One sorted TSV file, whose rows stream to the driver, or without ``single`` a folder of sorted parts written where the rows are."""
    if not single:
        flat = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[\t\n\r]", " ")
        rows = df.orderBy(*order).select(*[flat(c).alias(h) for c, h in zip(columns, header, strict=True)])
        rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)
        return path
    clean = lambda v: str(v).replace("\t", " ").replace("\n", " ").replace("\r", " ")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(header) + "\n")
        for row in df.orderBy(*order).select(*columns).toLocalIterator():
            f.write("\t".join(clean(v) for v in row) + "\n")
    return path


def write_summary_tsv(pairs: DataFrame, docs: DataFrame, threshold: float, path: str, inter: bool = False, single: bool = True) -> str:
    header = ["DocumentFilename", "SimilarityFrequency", "RelatedDocuments", "LongSimilarities(>4words)"]
    columns = ["document_filename", "similarity_frequency", "related_documents", "long_similarities"]
    return write_tsv(summary(pairs, docs, threshold, inter), path, header, ["doc_idx"], columns, single)


def named_variations(pairs: DataFrame, docs: DataFrame, threshold: float, fuzz: float = 0.75, max_gap: int = 5) -> DataFrame:
    """(i, j, seq, pos, file_1, file_2, variation_type, token_1, token_2) of all pairs at or above the threshold."""
    kept = pairs.where((F.col("score") >= threshold) & (F.col("i") != F.col("j")))
    found = align.variations(align.gaps(align.align(kept, docs)), fuzz, max_gap)
    names = docs.select("doc_idx", F.coalesce("name", F.lit("")).alias("file"))
    return found.join(names.toDF("i", "file_1"), "i").join(names.toDF("j", "file_2"), "j").select("i", "j", "seq", "pos", "file_1", "file_2", "variation_type", "token_1", "token_2")


def write_variations_tsv(pairs: DataFrame, docs: DataFrame, threshold: float, path: str, fuzz: float = 0.75, max_gap: int = 5, single: bool = True) -> str:
    header = ["File_1", "File_2", "Variation_Type", "Token_1", "Token_2"]
    return write_tsv(named_variations(pairs, docs, threshold, fuzz, max_gap), path, header, ["i", "j", "seq", "pos"], [h.lower() for h in header], single)


def write_heatmap(pairs: DataFrame, docs: DataFrame, path: str, featureful: DataFrame | None = None, limit: int = HEATMAP_LIMIT) -> str | None:
    """The dense matrix as a self-contained page with a canvas; None beyond ``limit`` documents a side.

    ``featureful`` (doc_idx) are the documents with features of a corpus compared with itself, None for two corpora.
    """
    inter = featureful is None
    ids = lambda corpus, end: docs.where(F.col("corpus") == corpus).select(F.col("doc_idx").alias(end))
    rows, columns = ids(1, "i"), ids(2 if inter else 1, "j")
    if rows.count() >= limit or columns.count() >= limit:
        return None
    name = {r["doc_idx"]: r["name"] or "" for r in docs.select("doc_idx", "name").collect()}  # fewer than 2 * limit rows
    row_ids, column_ids = (sorted(r[0] for r in x.collect()) for x in (rows, columns))
    cells = {(r["i"], r["j"]): r["score"] for r in dense_matrix(pairs, rows, columns, None if inter else featureful.select(F.col("doc_idx").alias("i")), limit).where("score > 0").toLocalIterator()}
    lines = [[round(cells.get((i, j), 0.0), 4) for j in column_ids] for i in row_ids]
    height, width = max(600, 20 * len(row_ids)), max(700, 20 * len(column_ids))
    title = "Similarity between two corpora" if inter else "Similarity within the corpus"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><p id="at"></p>
<canvas id="c" width="{width}" height="{height}"></canvas><script>
const m={lines},r={[html.escape(name[i]) for i in row_ids]},k={[html.escape(name[j]) for j in column_ids]};
const c=document.getElementById('c'),g=c.getContext('2d'),w=c.width/k.length,h=c.height/r.length;
m.forEach((x,i)=>x.forEach((s,j)=>{{const t=Math.min(1,s);g.fillStyle=`rgb(${{255-Math.round(247*t)}},${{255-Math.round(207*t)}},${{255-Math.round(148*t)}})`;g.fillRect(j*w,i*h,w,h)}}));
c.onmousemove=e=>{{const i=Math.floor(e.offsetY/h),j=Math.floor(e.offsetX/w);document.getElementById('at').textContent=`${{r[i]}} / ${{k[j]}}: ${{m[i][j]}}`}};
</script></body></html>
""")
    return path


def write_pairs(pairs: DataFrame, path: str) -> str:
    """The similarity table as Parquet."""
    pairs.write.mode("overwrite").parquet(path)
    return path
