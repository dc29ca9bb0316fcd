from collections import Counter

from llm_cases import clashing, docs, odd_rows, rows_of, words

from selenogrid.llm import quality
from selenogrid.session import write_table

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    w = split(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if split(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_counts_match_brute_force(spark):
    rows = odd_rows()
    texts = ["a b c d e " * 7, "x " * 9, "x " * 200, words(50, 1) + " " + words(50, 1), "\n".join(["one two", "one two", " ", "", "one two ", "three"]), "# * $ % & | < > #",
             words(12, 5) + " a b c d e f " + words(9, 6) + " b c d e f g", "\x0ba\x0cb\rc d e f g h i j k l", "é\xa0è ü"]
    rows += [(500 + i, t, "en", "src0", 1) for i, t in enumerate(texts)]
    got = rows_of(quality.document_stats(clashing(docs(spark, rows))), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(got) == Counter((r[0], *brute(r[1])) for r in rows)


def test_hosts_are_drawn_to_the_rate_of_all(spark):
    good, bad = words(40, 1), "x " * 40
    rows = [(i, good, "en", f"h{i % 10}", 1) for i in range(400)]
    rows += [(1000 + i, bad if i % 10 else good, "en", "spam", 1) for i in range(200)]
    rows += [(2000, bad, "en", "one", 1), (2001, good, "en", None, 1), (2002, bad, "en", None, 1), (2003, good, "en", "one", 1)]
    stats = write_table(quality.document_stats(docs(spark, rows)), "stats")
    verdicts = {r.host: r for r in quality.host_verdicts(stats).collect()}
    assert verdicts["spam"].host_rejected and not verdicts["h0"].host_rejected and None not in verdicts
    mean = 182 / 602
    assert verdicts["h0"].host_rate < mean < verdicts["spam"].host_rate < 0.9  # drawn towards the mean
    assert (verdicts["one"].n_docs, verdicts["one"].n_failed) == (2, 1) and abs(verdicts["one"].host_rate - mean) < 0.2
    kept = {r.doc_id for r in quality.judge(stats).filter("kept").collect()}
    assert kept == set(range(400)) | {2001, 2003}
    out = quality.apply(clashing(docs(spark, rows)))
    assert out.columns == clashing(docs(spark, [])).columns and {r.doc_id for r in out.collect()} == kept


def test_documents_that_fail_a_rule_go_unless_their_host_is_trusted(spark):
    good, bad, signs = words(40, 1), "x " * 40, words(40, 2) + " $$$$$$"
    rows = [(1000 * h + i, (signs if i % 2 else bad) if i < 20 * (h + 1) else good, "en", f"h{h}", 1) for h in range(4) for i in range(200)]
    rows += [(9000 + i, signs if i == 0 else good, "en", "fine", 1) for i in range(300)] + [(9900, signs, "en", None, 1), (9901, good, "en", None, 1)]
    stats = write_table(quality.document_stats(docs(spark, rows)), "stats")
    verdicts = {r.host: r for r in quality.host_verdicts(stats).collect()}
    assert verdicts["fine"].host_trusted and not verdicts["h3"].host_trusted and not any(v.host_rejected for v in verdicts.values())
    kept = {r.doc_id for r in quality.judge(stats).filter("kept").collect()}
    # of the ordinary hosts only the documents without a failure, of the trusted one also the document full of signs
    assert kept == {1000 * h + i for h in range(4) for i in range(20 * (h + 1), 200)} | set(range(9000, 9300)) | {9901}


def test_empty_table_and_one_host(spark):
    assert quality.apply(docs(spark, [])).count() == 0
    assert quality.apply(docs(spark, [(1, "x " * 50, "en", "a", 1), (2, None, "en", None, 1)])).count() == 0
