import random

from tests.llm.helpers import SCHEMA, empty_docs, odd_docs
from tidemark.llm import language

SYLLABLES = {"aa": "ka to mi ra su ne".split(), "bb": "schl ung ver ein keit".split(), "cc": "eau tion ré oui ment".split()}


def sentence(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows(n, seed=0):
    return [(k, sentence(lang, seed + k, 30), lang, "src0") for k, lang in enumerate(list(SYLLABLES) * n)]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(rows(40), SCHEMA)
    train = docs.where(~language.held_out())
    got = {r["doc_id"]: r for r in language.languages(docs, train).collect()}
    held = {r["doc_id"] for r in docs.where(language.held_out()).collect()}
    assert len(held) > 10 and len(got) == 120
    assert sum(got[d]["lang_pred"] == lang for d, _, lang, _ in rows(40) if d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_fold_is_crc32(spark):
    import zlib

    ids = [0, 1, 2, 3, 77, -5, 10**12]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", language.held_out().alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_same_sizes_by_hand(spark):
    import zstandard

    docs = spark.createDataFrame(rows(20), SCHEMA)
    pieces = language.samples(docs, 5, 100)
    assert {k: len(v) for k, v in pieces.items()} == dict.fromkeys(SYLLABLES, 5) and all(len(p) <= 100 for v in pieces.values() for p in v)
    known = language.dictionaries(pieces, 1 << 18)
    t = sentence("bb", 999, 50)
    sizes = {}
    for lang, data in known.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes[lang] = len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(t.encode()))
    best, score = language.predict(t, tuple(sorted(known.items())))
    low = sorted(sizes.values())
    assert best == "bb" == min(sizes, key=sizes.get) and abs(score - (low[1] - low[0]) / low[1]) < 1e-12


def test_odd_cases(spark):
    docs = odd_docs(spark)
    got = language.languages(docs, docs.where(~language.held_out())).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == by[6]["lang_pred"] == by[10]["lang_pred"] == "und" and by[4]["score"] == 0
    none = empty_docs(spark)
    assert language.languages(none, none).count() == 0
    assert {r["lang_pred"] for r in language.languages(docs, none).collect()} == {"und"}


def test_numbers_are_no_letters():
    assert not any(map(language.has_letter, ("² ½ ³", "12_", "", "Ⅻ ٣"))) and language.has_letter("½é") and language.has_letter("漢")
