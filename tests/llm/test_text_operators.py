"""PII, digests, packing, lines, languages: brute force on fixtures and the small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqrank.llm import digests, languages, lines, packing, pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.c a@b.c.d@e.f x+y@z-1.org. @no.org a@b a@b.c+d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111 1111  1111 1111", "+1 (262) 555-3752 call +49 30 12 +123456789012345678 ++1 23456 789012",
    "é" * 50 + " 😀 a@b.co " + "\u0001" + "c@d.org", "x" * 5000 + "@", "1" * 3000, "+1" + " " * 3000, "1 " * 2000, "a." * 2000 + "@b.c",
    "iban GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433", "phone 262-555-3752 and 262-555-3753 without", "n" * 50 + " 262-555-3752",
]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c)
        total += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return total % 10 == 0


def base_spans(text):
    out, counts = [], []
    for k, (name, pattern) in enumerate(PLAIN.items()):
        n = 0
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": name == "ip" and all(int(q) <= 255 for q in m.group().split(".")), "card": 14 <= len(number) <= 19 and luhn(number), "phone": 10 <= len(number) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end(), name))
                n += 1
        counts.append(n)
    return counts, ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def test_pii_against_plain_patterns(make_docs, documents):
    for docs in (make_docs(HARD), documents):
        rows = pii.find(docs).select("text", "pii", pii.described(F.filter("pii", lambda s: s["kind"] < pii.BASE_KINDS)).alias("base")).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r["base"] == base_spans(r["text"])[1]
            for s in r["pii"]:
                assert r["text"][s["start"]:s["end"]] == s["value"]


def test_pii_checksums_and_context(make_docs):
    got = {r["doc_id"]: r["all"] for r in pii.find(make_docs(HARD, edge=False)).select("doc_id", pii.described(F.col("pii")).alias("all")).collect()}
    assert got[10] == "iban:5:32"
    assert got[11].startswith("local_phone:6:18") and got[12] == ""


def test_pii_query_and_redaction(spark, make_docs, documents, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op3_pii(spark, sf_dir).collect()}
    for r in documents.collect():
        counts, text = base_spans(r["text"])
        q = rows[r["doc_id"]]
        assert [q["n_email"], q["n_ip"], q["n_card"], q["n_phone"]] == counts
        assert q["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    red = {r["doc_id"]: r["text"] for r in pii.redact(make_docs(["mail a@b.org now", "none"], edge=False)).collect()}
    assert red == {0: "mail <email> now", 1: "none"}


def test_many_spans_in_one_text(make_docs):
    text = "x a@b.co " * 3000
    row = pii.find(make_docs([text], edge=False)).select(pii.described(F.col("pii")).alias("s")).first()
    assert row["s"] == base_spans(text)[1]


def test_digest_query_matches_sequential_walk(spark, sf_dir, documents):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()))
    got = {r["doc_id"]: r for r in queries.op5_digest(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        g = got[i]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert g["fingerprint"] == digests.to_text(digests.digest(t.encode()))
        assert g["near_next"] == digests.likeness(digests.digest(t.encode()), digests.digest(after.encode()))
    assert np.mean([g["near_edited"] > g["near_next"] for g in got.values()]) > 0.95


def test_digest_edges(make_docs, spark):
    rows = digests.compare_edited(make_docs(["abc", "abc", "other text of some length"]), parts=4).collect()
    assert len(rows) == 8 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[0] == prints[1] and prints[3] == prints[4]
    one = make_docs(["alone"], edge=False)
    assert digests.compare_edited(one).first()["near_next"] == 1.0
    assert digests.compare_edited(one.limit(0)).count() == 0
    assert digests.fingerprints(make_docs(["abc"])).count() == 6


@pytest.mark.parametrize("text", ["", "a" * 30000, " " * 9000, "<|endoftext|> a", "\n\n a  \n b", "ab1" * 3000, "é" * 3000 + " " * 3000 + "!" * 3000, "x'll  don't\t\r\n1234"])
def test_ids_equal_the_tokenizer(text):
    path = packing.default_tokenizer()
    assert packing.ids_of(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def check_packed(rows, size):
    by_seq, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return by_seq


def test_packing_round_trip(spark, sf_dir, documents):
    rows = queries.op6_packing(spark, sf_dir).collect()
    seqs = check_packed(rows, 1024)
    totals = [sum(n for _, n in p) for p in seqs.values()]
    assert sum(1024 - t for t in totals if t & (t - 1)) < 0.02 * 1024 * len(totals)
    t = Tokenizer.from_file(packing.default_tokenizer())
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for d in documents.collect():
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_packing_edges(make_docs):
    rows = packing.pack_documents(make_docs(["a b c"] * 40 + ["word " * 3000]), size=64).collect()
    check_packed(rows, 64)
    assert sum(r["length"] == 1 and r["doc_tokens"] == 1 for r in rows) == 2
    assert packing.pack_documents(make_docs([], edge=False)).count() == 0
    patterns = packing.shortest_pack_first({5: 3, 3: 4, 1: 100}, 10)
    used = collections.Counter()
    for n, lengths in patterns:
        assert sum(lengths) <= 10
        for x in lengths:
            used[x] += n
    assert used == {5: 3, 3: 4, 1: 100}


def brute_lines(docs):
    seen, out = set(), {}
    for key, text in docs:
        ls = (text or "").split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i:i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[key] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def test_lines_against_brute_force(make_docs, documents):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\nd\ny", "a\nb\nc", "1\n2\n1\n2\n1\n2\n1", "\n\n\n\n", "a\nb", "q\nb\nc\nd\nq\nb\nc\nd\ne\n" * 3]
    for docs in (make_docs(texts, edge=False), documents):
        rows = docs.orderBy("doc_id").collect()
        want = brute_lines([(r["doc_id"], r["text"]) for r in rows])
        got = {r["doc_id"]: r["text"] for r in lines.remove_repeats(docs).collect()}
        assert got == want


def test_lines_edges(make_docs):
    docs = make_docs(["a\nb\nc", "a\nb\nc"])
    out = lines.remove_repeats(docs)
    assert out.columns == [*docs.columns, "_lines", "_kept"] and out.count() == 7
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] == "a\nb\nc" and texts[1] == "" and texts[2] is None
    assert lines.remove_repeats(docs.limit(0)).count() == 0


def test_languages(spark, sf_dir, documents):
    rows = queries.op2_language(spark, sf_dir).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    truth = {i: m.group(1) for i, u in pages.items() if (m := re.match(r"\w+://[^/]+/([a-z]{2})[/?#]", u))}
    assert np.mean([r["lang"] == truth[r["page_id"]] for r in rows if r["page_id"] in truth]) >= 0.98
    assert all(0 <= r["prob"] <= 1 for r in rows)


def test_language_evidence_and_edges(spark, documents):
    fr = [r["text"] for r in documents.where("lang = 'fr'").limit(30).collect()]
    de = [r["text"] for r in documents.where("lang = 'de'").limit(10).collect()]
    rows = [(i, f"https://www.site.fr/{i}", f"<html lang='fr'><body>{t}</body></html>") for i, t in enumerate(fr)]
    rows += [(100 + i, f"https://andere.de/{i}", f"<html lang='de'><p>{t}") for i, t in enumerate(de)]
    rows += [(200, "https://www.site.fr/empty", None), (201, None, None), (202, "", ""), (203, "nonsense", "<script>x"), (204, "https://andere.de/x", "<html lang=de>")]
    rows += [rows[0], (None, "https://u:p@andere.de:80/x", "<p>hallo</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as lang", "1 as host")
    got = {r["page_id"]: r["lang"] for r in languages.identify(pages, documents).collect()}
    assert all(got[i] == "fr" for i in range(len(fr))) and got[200] == "fr" and got[204] == "de"
    assert languages.identify(pages, documents).count() == len(rows)
    assert languages.identify(pages.limit(0), documents).count() == 0
    assert {r["lang"] for r in languages.identify(pages, documents.limit(0)).collect()} == {None}


def plain_languages(pages, docs):
    """(language, probability) of each page by loops over pages and languages."""
    counts = {}
    for lang, text in docs:
        at = counts.setdefault(lang, np.full(languages.BUCKETS, 0.5))
        for b in languages.triplets(text):
            at[b] += 1
    names = sorted(counts)
    table = [np.log(counts[n] / counts[n].sum()) for n in names]
    rows = []
    for url, html in pages:
        host = (re.match(languages._HOST, url or "") or [None, ""])[1].lower()
        end = host.split(".")[-1]
        end = end if re.fullmatch("[a-z]{2,3}", end) else "none"
        declared = (re.search(languages._DECLARED, html or "") or [None, "none"])[1].lower()
        got = languages.triplets(" ".join(re.sub(languages._TAGS, " ", html or "").split()))
        ll = np.array([sum(t[b] for b in got) * min(1, 60 / len(got)) if len(got) > 2 else 0.0 for t in table])
        p = np.exp(ll - ll.max())
        rows.append((host, ".".join(host.split(".")[-2:]), end, declared, ll, p / p.sum()))
    out = []
    whole = sum(r[5] for r in rows)
    for host, domain, end, declared, ll, p in rows:
        def of(at, value):
            return sum((r[5] for r in rows if r[at] == value), np.zeros(len(names)))
        h, d = (np.maximum(of(at, v) - p, 0) for at, v in ((0, host), (1, domain)))
        base = (whole + 1) / (whole.sum() + len(names))
        above = (d + 8 * base) / (max(of(1, domain).sum() - 1, 0) + 8)
        f = ll + np.log((h + 4 * above) / (max(of(0, host).sum() - 1, 0) + 4))
        for at, v in ((2, end), (3, declared)):
            share = (of(at, v).sum() + 1) / (whole.sum() + 1)
            f = f + np.log((np.maximum(of(at, v) - p, 0) + 5 * share) / (np.maximum(whole - p, 0) + 5))
        e = np.exp(f - f.max())
        out.append((names[int(np.argmax(f))], float(e.max() / e.sum())))
    return out


@pytest.mark.parametrize("size", [256, 2, 1])
def test_languages_against_a_plain_loop(spark, documents, monkeypatch, size):
    monkeypatch.setattr(languages, "LANGUAGES", size)
    docs = [(r["lang"], r["text"][:300]) for r in documents.where("lang IS NOT NULL AND text IS NOT NULL").limit(60).collect()] + [("zz", ""), ("yy", "ab")]
    pages = [(f"https://{'www' if i % 3 else 'm'}.site{i % 4}.{('fr', 'de', 'com')[i % 3]}/{i}", f"<html lang='{docs[i][0]}'><p>{docs[i][1][:40 + i]}</p>") for i in range(40)]
    pages += [(None, None), ("", "<p>x"), ("https://site1.fr/", "<html lang=qq>")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in languages.identify(frame, spark.createDataFrame(docs, "lang string, text string")).collect()}
    for i, (lang, prob) in enumerate(plain_languages(pages, docs)):
        assert got[i]["prob"] == pytest.approx(prob, abs=1e-6) and (got[i]["lang"] == lang or prob < 0.5)


def test_more_languages_than_a_table(spark):
    docs = spark.range(300).selectExpr("concat('l', id) AS lang", "repeat(concat(char(97 + id % 26), char(97 + id div 26), 'q '), 30) AS text")
    pages = docs.selectExpr("cast(substr(lang, 2) AS bigint) AS page_id", "concat('https://h', page_id % 7, '.org/') AS url", "concat('<p>', text) AS html")
    got = languages.identify(pages, docs).collect()
    assert len(got) == 300 and all(r["text_lang"] == f"l{r['page_id']}" for r in got)


def test_digests_of_many_rows_without_id(make_docs, spark):
    """Null and repeated ids at the ends of ranges: each row has one result, and the successor is the next in order of (id, text hash)."""
    docs = make_docs([f"text number {i} " * (i % 5 + 1) for i in range(40)], edge=False).select("doc_id", "text")
    nulls = docs.selectExpr("cast(NULL AS bigint) AS doc_id", "concat(text, ' x') AS text")
    again = docs.where("doc_id IN (0, 9, 10, 20, 30)").selectExpr("doc_id", "explode(transform(sequence(1, 6), i -> concat(text, i))) AS text")
    every = docs.unionByName(nulls).unionByName(again).unionByName(docs.where("doc_id = 10"))
    from pyspark.sql import functions as F
    order = [(r["doc_id"], r["text"]) for r in every.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    want = collections.Counter()
    for i, (doc_id, text) in enumerate(order):
        after, n = order[(i + 1) % len(order)][1], len(text)
        half = n // 2
        want[(doc_id, n, hashlib.sha256((text[:n - half] + after[:half]).encode()).hexdigest())] += 1
    for parts in (1, 4, 9):
        got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in digests.compare_edited(every, parts=parts).collect())
        assert got == want


def test_repeated_labelled_rows_count_once(spark):
    from seqrank.llm import common

    docs = spark.createDataFrame([(1, "a")] * 50 + [(1, "b"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (9, 1)], "doc_id long, quality int")
    from pyspark.sql import functions as F
    ids = common.labelled_sample(labels, "quality", F.lit(True), 10)
    got = {r["doc_id"]: (r["label"], r["text"]) for r in common.labelled_texts(docs, ids).collect()}
    assert set(got) == {1, 2} and got[1][0] == 1 and got[1][1] in "ab" and got[2] == (0, None)


def test_added_kinds_and_scores_against_a_plain_loop(make_docs, documents):
    """Matches, checksums, context words and scores of every kind, one text at a time."""
    import regex

    extra = ["IBAN GB82 WEST 1234 5698 7654 32 thanks", "DE89370400440532013000", "DE89370400440532013001 bank", "call (415) 555-2671 or 415.555.2672", "415 555 2671",
             "x" * 60 + " phone " + "y" * 39 + " 415-555-2671", "konto: FR1420041010050500013M02606.", "mail a@b.org, fax +49 30 1234567, host 10.0.0.1, visa 4111 1111 1111 1111"]
    for docs in (make_docs(extra, edge=False), documents):
        for r in pii.find(docs).select("text", "pii").collect():
            t = r["text"] or ""
            want = []
            for k, kind in enumerate(pii.KINDS):
                for m in regex.finditer(pii.PATTERNS[kind], t):
                    v = m.group()
                    n = "".join(c for c in v if c in "0123456789")
                    if kind == "ip" and any(int(p) > 255 for p in v.split(".")):
                        continue
                    if kind == "card" and not (14 <= len(n) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(n))) % 10 == 0):
                        continue
                    if kind == "phone" and not 10 <= len(n) <= 15:
                        continue
                    if kind == "iban":
                        plain = v.replace(" ", "")
                        if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
                            continue
                    # The context reaches to the neighbouring matches of the kind at most.
                    others = [o for o in regex.finditer(pii.PATTERNS[kind], t) if o.span() != m.span()]
                    lo = max([o.end() for o in others if o.end() <= m.start()], default=0)
                    hi = min([o.start() for o in others if o.start() >= m.end()], default=len(t))
                    near = t[max(lo, m.start() - 40):m.start()] + " " + t[m.end():min(hi, m.end() + 20)]
                    score = min(1.0, pii.START[kind] + (0.2 if regex.search(rf"\b(?:{pii.CONTEXT[kind]})", near.lower()) else 0.0))
                    if k < pii.BASE_KINDS or score >= pii.MIN_SCORE:
                        want.append((m.start(), k, m.end(), round(score, 3)))
            assert sorted(want) == [(s["start"], s["kind"], s["end"], s["score"]) for s in r["pii"]], t[:200]
