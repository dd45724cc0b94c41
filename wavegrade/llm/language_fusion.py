"""Language of web pages by Bayesian evidence fusion.

A page's text has a likelihood under each language's hashed byte trigrams, counted over all documents with
a language. That decides a first language; grouped counts of first languages give P(declared markup language
| language), P(address suffix | language) and host priors, smoothed from the site's domain, that from the
suffix and that from all pages, each page's own vote taken out of its own priors. The posterior multiplies
all of them. A suffix in COUNTRY_SUFFIXES also speaks for its language.

Counts by host, domain and suffix are partial sums before their shuffle. As one host may hold most pages, the
priors are joined to pages by Spark's shuffle join, which splits large groups of pages.

Edge cases: null or empty pages have no text evidence, a null url no host (the empty one), a missing lang
attribute is the empty declaration; without any labelled document all languages are null; ties go to the
language first in the alphabet; repeated rows are judged each; an empty table gives an empty one; of both
tables only the named columns are read; a page of any length is read whole, its trigrams being counted into
a table of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import blocks, raw_texts, written

SLOTS, HOST_WEIGHT, DOMAIN_WEIGHT, SUFFIX_WEIGHT, SUFFIX_ODDS, TEXT_WEIGHT = 8192, 8.0, 20.0, 40.0, 4.0, 0.25

# Address suffixes that speak for a language.
COUNTRY_SUFFIXES = {"at": "de", "ca": "en", "cl": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "uk": "en", "us": "en"}

#: What holds no text; each kind ends at its own closing mark.
_open = re.compile(rb"<(script|style|nav)\b|(<!--)|(<div class=\"ad\">)", re.I)
_tag = re.compile(rb"<[^>]*>")
_html = re.compile(rb"<html\b", re.I)
_lang = re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def untagged(html: bytes) -> bytes:
    """The page with a blank for each tag; what follows the last closing bracket is no tag, and isn't looked through for one."""
    end = html.rfind(b">") + 1
    return _tag.sub(b" ", html[:end]) + html[end:]


def declared_in(html: bytes) -> bytes | None:
    """The language that the first html tag with one names. Tags that are open at the same closing bracket are looked through once."""
    done = -1
    for m in _html.finditer(html):
        if m.start() < done:
            continue
        end = html.find(b">", m.end())
        done = len(html) if end < 0 else end
        found = _lang.search(html, m.end(), done)
        if found:
            return found.group(1)
    return None


def visible(html: bytes) -> bytes:
    """The page without scripts, styles, menus, comments and advertisements; a block that never closes is kept. One pass: a closing mark not found is not looked for again."""
    out, at, low, missing = [], 0, html.lower(), set()
    for m in _open.finditer(html):
        if m.start() < at:
            continue
        close = b"</" + m.group(1).lower() if m.group(1) else b"-->" if m.group(2) else b"</div>"
        if close in missing:
            continue
        end = low.find(close, m.end())
        if end < 0:
            missing.add(close)
            continue
        stop = low.find(b">", end + len(close) - 1)
        out.append(html[at : m.start()])
        at = len(html) if stop < 0 else stop + 1
    return b" ".join([*out, html[at:]])


def slots(text: bytes) -> np.ndarray:
    """The slot of each byte trigram of a text, ASCII letters small."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.int64)
    return ((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) % SLOTS if len(b) > 2 else np.zeros(0, np.int64)


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, and log P(slot | language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in blocks(batches, text_col):
            for lang, t in zip(batch.column(lang_col).to_pylist(), raw_texts(batch, text_col), strict=True):
                if lang not in total:
                    total[lang] = np.zeros(SLOTS, np.int64)
                total[lang] += np.bincount(slots(t), minlength=SLOTS)
        for lang, n in total.items():
            s = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s)), pa.array(s), pa.array(n[s])], names=["lang", "slot", "n"])

    got = docs.where(F.col(lang_col).isNotNull()).select(text_col, F.col(lang_col)).mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))  # SLOTS rows for each language
    counts = np.full((len(langs), SLOTS), 0.5)
    if langs:
        np.add.at(counts, (np.searchsorted(langs, got.column("lang").to_numpy(zero_copy_only=False).astype(str)), got.column("slot").to_numpy()), got.column("n").to_numpy())
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: the id, declared, text_lang, lang and posterior."""
    langs, model = text_model(docs)
    of_id, k = dict(pages.dtypes)[id_col], len(langs)
    if not k:
        return pages.select(id_col, F.lit("").alias("declared"), *(F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")), F.lit(None).cast("double").alias("posterior"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, html_col):
            declared, rows = [], []
            for html in raw_texts(batch, html_col):
                declared.append((declared_in(html) or b"").decode().lower())
                ll = model @ np.bincount(slots(b" ".join(untagged(visible(html)).split())), minlength=SLOTS)
                rows.append((TEXT_WEIGHT * (ll - ll.max())).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("_host"), pa.array(declared, pa.string()), pa.array(rows, pa.list_(pa.float64()))], names=[id_col, "host", "declared", "ll"])

    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    seen = pages.select(id_col, html_col, host.alias("_host")).mapInArrow(run, f"`{id_col}` {of_id}, host string, declared string, ll array<double>")
    seen = seen.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("best", F.array_position("ll", F.array_max("ll")).cast("int"))
    seen = written(seen, "page-evidence")
    seen = seen.withColumn("suffix", F.substring_index("host", ".", -1))
    votes = F.array(*(F.sum((F.col("best") == i + 1).cast("double")) for i in range(k)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    each = lambda col: F.array(*(F.sum(F.col(col)[i]) for i in range(k)))
    counted = written(seen.groupBy("host", "domain", "suffix", "declared").agg(votes.alias("c")), "page-votes")
    hosts = counted.groupBy("host", "domain", "suffix").agg(each("c").alias("host_c"))
    domains = hosts.groupBy("domain", "suffix").agg(each("host_c").alias("domain_c"))
    suffixes = domains.groupBy("suffix").agg(each("domain_c").alias("suffix_c"))
    declared = counted.groupBy("declared").agg(each("c").alias("declared_c"))
    everywhere = counted.agg(each("c").alias("c"), F.count_distinct("declared").alias("d"), F.count_distinct("suffix").alias("s")).first()
    total = F.array(*(F.lit(float(x or 0)) for x in everywhere["c"] or [0.0] * k))
    own = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (i == F.col("best")).cast("double"))
    less = lambda c: F.zip_with(c, own, lambda x, y: x - y)
    smooth = lambda c, p, w: F.zip_with(less(c), p, lambda x, q: (x + w * q) / (size(less(c)) + w))
    everywhere_p = F.transform(less(total), lambda x: (x + 1) / (size(less(total)) + k))
    prior = smooth(F.col("host_c"), smooth(F.col("domain_c"), smooth(F.col("suffix_c"), everywhere_p, SUFFIX_WEIGHT), DOMAIN_WEIGHT), HOST_WEIGHT)
    declared_p = F.zip_with(less(F.col("declared_c")), less(total), lambda c, t: (c + 0.5) / (t + 0.5 * float(everywhere["d"] or 1)))
    named = F.create_map(*(F.lit(x) for pair in COUNTRY_SUFFIXES.items() for x in pair))
    spoken = F.coalesce(F.try_element_at(named, F.col("suffix")), F.col("suffix"))
    suffix_log = F.array(*(F.when(spoken == x, F.lit(float(np.log(SUFFIX_ODDS)))).otherwise(0.0) for x in langs))
    by_host = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select("host", "host_c", "domain_c", "suffix_c")
    joined = seen.join(by_host, "host").join(declared, "declared")
    logs = add(add(add(F.col("ll"), F.transform(prior, lambda x: F.log(x))), F.transform(declared_p, lambda x: F.log(x))), suffix_log)
    joined = joined.withColumn("s", logs)
    names, top = F.array(*(F.lit(x) for x in langs)), F.array_max("s")
    return joined.select(
        id_col, "declared", F.element_at(names, F.col("best")).alias("text_lang"), F.element_at(names, F.array_position("s", top).cast("int")).alias("lang"),
        (1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("posterior"),
    )
