"""Classifiers, surrogates, packing and records."""

import ipaddress
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aeromart.llm import langid, packing, records, toxicity
from aeromart.llm.queries import tokenizer_path
from aeromart.llm.surrogates import PATTERN, _drawn, assign_surrogates, replace_entities
from tests.llm import cases


# ------------------------------------------------------------------ language
def two_languages(spark):
    rows = [(i, "the thing and that other thing is here " * 3, "en") for i in range(30)]
    rows += [(100 + i, "der und die nicht ein schön straße über " * 3, "de") for i in range(30)]
    return spark.createDataFrame(rows + [(900, None, "en"), (901, "text", None)], "doc_id long, text string, lang string")


def test_language_of_texts(spark):
    model = langid.learn_profiles(two_languages(spark))
    rows = [(1, "that is the other"), (2, "und nicht über die"), (3, None), (4, ""), (5, "123 !!"), (6, "a" * 100_000)]
    docs = spark.createDataFrame([(*r, "old", 9.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.predict_language(docs, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "de")
    for i in (3, 4, 5):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict_language(cases.empty(spark), model).count() == 0


def test_nothing_learned_is_unknown(spark):
    model = langid.learn_profiles(cases.empty(spark))
    assert {r.lang_pred for r in langid.predict_language(cases.documents(spark), model).collect()} == {"und"}


def test_profile_distance_against_the_definition():
    langs, size = ["x", "y"], 5
    vocabulary = np.array([1, 2, 3, 4], np.int64)
    ranks = np.array([[0, -1], [1, 2], [-1, 0], [2, 1]])
    text = "abcab"
    codes, counts = np.unique(langid.gram_codes(text), return_counts=True)
    top = [c for c, _ in sorted(zip(codes.tolist(), counts.tolist()), key=lambda p: (-p[1], p[0]))][:size]
    expected = []
    for j in range(2):
        profile = {int(v): int(ranks[i, j]) for i, v in enumerate(vocabulary) if ranks[i, j] >= 0}
        expected.append(sum(abs(profile[g] - i) if g in profile else size for i, g in enumerate(top)))
    lang, score = langid.nearest(text, langs, vocabulary, ranks, size)
    assert score == 1 - min(expected) / (size * len(top)) and lang == langs[expected.index(min(expected))]


# ------------------------------------------------------------------ toxicity
def kernel_by_force(a, b, decay):
    def weights(s):
        out = {}
        for size in (2, 3):
            for at in itertools.combinations(range(len(s)), size):
                u = bytes(s[i] for i in at)
                out[u] = out.get(u, 0) + decay ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_subsequence_kernel_against_the_definition():
    r = random.Random(4)
    for _ in range(60):
        a, b = (bytes(r.choice(b"abcd") for _ in range(r.randint(2, 7))) for _ in range(2))
        got = toxicity.raw_kernel(np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8)[None])[0]
        assert got == pytest.approx(kernel_by_force(a, b, toxicity.DECAY), rel=1e-4)


def toxic_sample(spark):
    r, rows = random.Random(6), []
    for i in range(400):
        w, bad = cases.words(30, 1000 + i), i % 4 == 0
        if bad:
            w[r.randrange(30)] = r.choice(["zorgblatt", "quixfump"])
        rows.append((i, " ".join(w), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_a_worker_scores_a_word_once_for_all_its_tasks(monkeypatch):
    import pyarrow as pa

    def model(landmark, weight):
        return toxicity.Model([landmark], np.array([weight]), -1.0)

    def margins(of, *texts):
        batches = toxicity._margins(of)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
        return [v for b in batches for v in b.column("margin").to_pylist()]

    asked, plain = [], toxicity.Model.margins
    monkeypatch.setattr(toxicity.Model, "margins", lambda self, words: asked.extend(words) or plain(self, words))
    first = margins(model(b"rotten", 1.5), "rotten apples", "green apples")
    assert margins(model(b"rotten", 1.5), "apples rotten", "apples green", "ripe")[:2] == first and asked.count(b"apples") == 1 and asked.count(b"ripe") == 1
    assert margins(model(b"rotten", 0.5), "rotten apples") != first[:1]  # another model's words are its own
    assert margins(model(b"rotten", 1.5), "rotten apples") == first[:1]


def test_toxicity_is_learned_and_tolerates_changes(spark):
    model = toxicity.learn_toxicity(toxic_sample(spark))
    clean = " ".join(cases.words(25, 5))
    rows = [(1, clean + " Zorgblatt!!"), (2, clean + " zorg-blatt"), (3, clean + " z o r g b l a t t"), (4, clean + " zorgxblatt"), (5, clean), (6, None), (7, ""), (8, "zorgblatt " + "x" * 200_000)]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double"), model).collect()}
    assert [got[i].predicted for i in range(1, 9)] == [1, 1, 1, 1, 0, 0, 0, 1]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score_toxicity(cases.empty(spark), model).count() == 0


def test_without_labels_of_both_kinds_all_scores_are_equal(spark):
    model = toxicity.learn_toxicity(toxic_sample(spark).where("toxic = 0"))
    assert len({r.score for r in toxicity.score_toxicity(cases.documents(spark), model).collect()}) == 1


# ------------------------------------------------------------------ surrogates
PERSONAL = [
    (1, "Write to Ann.Lee@mail.example.com or ann.lee@mail.example.com, call +1 (017) 555-7713."),
    (2, "ann.lee@mail.example.com; card 4111111111111111 (4111 1111 1111 1111), host 10.1.2.3. End"),
    (3, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" and 123-45-6789'),
    (4, "Mr John Smith met Mrs Mary Smith and Herr SMITH; г-жа Иванова Анна."),
    (5, "Nothing to see, 12 of 345."),
    (6, None),
    (7, ""),
    (None, "ann.lee@mail.example.com"),
]


def luhn(digits):
    d = [int(x) for x in digits][::-1]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10


def test_surrogates_keep_type_format_and_coreference(spark):
    docs = spark.createDataFrame([(*r, 5) for r in PERSONAL] + [(*PERSONAL[0], 5)], "doc_id long, text string, n_entities int")
    rows = replace_entities(docs, "k").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(PERSONAL) + 1 and [got[i].n_entities for i in (1, 2, 3, 5, 6, 7)] == [3, 4, 2, 0, 0, 0]
    assert got[5].text == PERSONAL[4][1] and got[6].text is None and got[7].text == ""
    one = re.fullmatch(r"Write to (\S+) or (\S+), call \+\d \(\d{3}\) \d{3}-\d{4}\.", got[1].text)
    assert one and one[1].lower() == one[2] and one[1] != one[2] and one[2] != "ann.lee@mail.example.com"
    two = re.fullmatch(r"(\S+); card (\d{16}) \((\d{4}) (\d{4}) (\d{4}) (\d{4})\), host (\d+\.\d+\.\d+\.\d+)\. End", got[2].text)
    assert two and two[1] == one[2] == got[None].text
    assert two[2] == "".join(two.group(3, 4, 5, 6)) != "4111111111111111" and luhn(two[2]) == 0
    assert all(0 <= int(x) < 256 for x in two[7].split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}" and \d{3}-\d{2}-\d{4}', got[3].text)
    names = re.fullmatch(r"Mr (\S+) (\S+) met Mrs (\S+) (\S+) and Herr (\S+); г-жа (\S+) (\S+)\.", got[4].text)
    assert names and names[2] == names[4] and names[5] == names[2].upper()
    assert names[1] not in ("John", names[3]) and names[3].endswith("a") and re.fullmatch("[А-Яа-я]+", names[7])
    assert replace_entities(cases.empty(spark), "k").count() == 0
    assert {r.text for r in replace_entities(docs, "other").collect()} != {r.text for r in rows}


def test_surrogates_are_distinct_and_never_an_entity(spark):
    rows = [(i, f"{100 + i}-{i % 90 + 10}-{1000 + i}" if i % 2 else f"{i % 250}.{i // 250}.1.1") for i in range(900)]
    got = [r.text for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert len(set(got)) == len(got) and not set(got) & {t for _, t in rows}


def test_surrogates_for_more_entities_than_the_form_has(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{a}@{b}.com, {a.upper()}@{b}.com") for i, (a, b) in enumerate(itertools.product(letters, letters))]
    got = [re.fullmatch(r"(\w+@\w+\.com), (\w+@\w+\.com)", r.text) for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert all(g and g[1] == g[2].lower() for g in got)
    assert len({g[1] for g in got}) == len(rows) and not {g[1] for g in got} & {t[:7] for _, t in rows}


def test_surrogates_for_more_names_than_three_syllables_give(spark):
    n = 13**3 * 5**3 + 1000
    names = spark.range(n).select(F.lit("family").alias("kind"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("entity"))
    got = assign_surrogates(names, "k")
    assert got.count() == n == got.select("surrogate").distinct().count() == got.select("entity").distinct().count()


def test_longer_forms_keep_the_type(spark):
    entities = [("card", "4111111111111111"), ("ssn", "123456789"), ("ip", "10.1.2.3"), ("secret", "sk-abcdefghijklmnop"), ("given-female", "ann"), ("family", "иванова"), ("email", "a@b.com")]
    rows = [(k, e, n) for k, e in entities for n in (0, 8, 40)]
    drawn = {(r.kind, r.attempt): r.surrogate for r in _drawn(spark.createDataFrame(rows, "kind string, entity string, attempt int"), "k").collect()}
    for k, e in entities:
        short, longer, longest = (drawn[k, n] for n in (0, 8, 40))
        assert len(longest) > len(longer) > len(short) or k == "ip"
    assert all(luhn(drawn["card", n]) == 0 for n in (0, 8, 40))
    assert ipaddress.ip_address(drawn["ip", 0]).version == 4 and ipaddress.ip_address(drawn["ip", 40]).is_private
    assert re.fullmatch(r"[a-z]{34}@[a-z]\.com", drawn["email", 40]) and re.fullmatch("[а-я]+", drawn["family", 40])


def test_later_mentions_without_the_title_are_the_same_person(spark):
    texts = [
        "Mr John Smith called. John Smith paid, then Smith left; John's car. Smithson and Johnny stayed.",
        "Mrs Anna Weber-Klein and Dr Li. Weber-Klein, Anna! Li is short. Klein is not hers.",
        "John Smith is named without a title here.",
        "г-н Иванов пришёл. Иванов ушёл.",
        None,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in replace_entities(docs, "k").collect()}
    first, last = re.match(r"Mr (\w+) (\w+) called", got[0].text).groups()
    assert got[0].text == f"Mr {first} {last} called. {first} {last} paid, then {last} left; {first}'s car. Smithson and Johnny stayed."
    assert {first, last} & {"John", "Smith"} == set() and got[0].n_entities == 4
    anna, weber = re.match(r"Mrs (\w+) ([\w-]+) and", got[1].text).groups()
    assert f". {weber}, {anna}! Li is short. Klein is not hers." in got[1].text
    assert got[2].text == texts[2] and got[2].n_entities == 0
    name = re.match(r"г-н (\w+) ", got[3].text)[1]
    assert got[3].text == f"г-н {name} пришёл. {name} ушёл." and name != "Иванов"
    assert got[4].text is None


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_surrogates_of_more_forms(spark):
    texts = [
        "MR JOHN SMITH and Mr John Smith, then dr García-Lorca met García-Lorca's Mrs O'Brien. O'Brien left.",
        "Mr 김철수 왔다. 김철수는 갔다. Mrs 王小明 Prof محمد",
        "host 2001:db8::ff00:42:8329, FE80::1A2B too; 12:30:45, std::vector<int>, a::b and ::1 stay",
        "pay DE89 3704 0044 0532 0130 00 or DE89370400440532013000, GB29NWBK60161331926819. GB29NWBK6016133ABCDEFG is none",
        "call 030 1234567, 0171/234 5678, 01 23 45 67 89 or 8 (495) 123-45-67, not 0123 456 and 10.05.2024",
        "jörg@exämple.de, Jörg@exämple.de, пётр@пример.рф",
        "I miss Anna; MS Word; DR Congo; the frau Holle",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in replace_entities(docs, "k").collect()}
    n = re.fullmatch(r"MR (\S+) (\S+) and Mr (\S+) (\S+), then dr (\w+-\w+) met (\w+-\w+)'s Mrs (\w+'\w+)\. (\w+'\w+) left\.", got[0].text)
    assert n and (n[1], n[2]) == (n[3].upper(), n[4].upper()) and n[5] == n[6] != "García-Lorca" and n[7] == n[8] != "O'Brien"
    assert all(part[0].isupper() and part[1:].islower() for name in (n[3], n[5], n[7]) for part in re.split("['-]", name))
    n = re.fullmatch(r"Mr ([가-힣]{3}) 왔다\. ([가-힣]{3})는 갔다\. Mrs ([\u4e00-\u9fff]{3}) Prof ([\u0600-\u06ff]{4})", got[1].text)
    assert n and n[1] == n[2] != "김철수" and n[3] != "王小明" and n[4] != "محمد"
    n = re.fullmatch(r"host ([0-9a-f:]+), ([0-9A-F:]+) too; 12:30:45, std::vector<int>, a::b and ::1 stay", got[2].text)
    assert n and n[1] != "2001:db8::ff00:42:8329" and [ipaddress.ip_address(x).version for x in n.groups()] == [6, 6]
    assert re.sub("[0-9a-f]", "x", n[1]) == re.sub("[0-9a-f]", "x", "2001:db8::ff00:42:8329")
    n = re.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20}), (GB\d\d[A-Z]{4}\d{14})\. GB29NWBK6016133ABCDEFG is none", got[3].text)
    assert n and n[1].replace(" ", "") == n[2] != "DE89370400440532013000" and mod97(n[2]) == mod97(n[3]) == 1 and got[3].n_entities == 3
    n = re.fullmatch(r"call (0\d\d \d{7}), (0\d{3}/\d{3} \d{4}), (0\d(?: \d\d){4}) or (\d \(\d{3}\) \d{3}-\d\d-\d\d), not 0123 456 and 10\.05\.2024", got[4].text)
    assert n and got[4].n_entities == 4 and not set(n.groups()) & {"030 1234567", "0171/234 5678", "01 23 45 67 89", "8 (495) 123-45-67"}
    n = re.fullmatch(r"([a-z]{4}@[a-z]{7}\.de), ([A-Z][a-z]{3}@[a-z]{7}\.de), ([а-я]{4}@[а-я]{6}\.рф)", got[5].text)
    assert n and n[1] == n[2].lower()
    assert got[6].text == texts[6] and got[6].n_entities == 0


def test_surrogates_against_brute_force(spark):
    """The rows of the query: all but the entities as it was, each entity in
    its own format, equal entities alike, different ones apart."""
    docs = cases.documents(spark).select("doc_id", "text").collect()
    docs = [tuple(r) for r in docs] + [(9000 + i, t) for i, (_, t) in enumerate(PERSONAL)]
    docs += [(9100 + i, f"call +1 (017) 555-{1000 + i % 40}, ssn {100 + i % 30}-11-2222 of user{i % 25}@mail{i % 5}.org at 10.0.{i % 20}.7") for i in range(120)]
    rows = replace_entities(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()
    pattern = regex.compile(re.sub(r"\\p\{Is(\w+)\}", r"\\p{\1}", PATTERN), regex.V1)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    forward, back = {}, {}
    for doc_id, text in docs:
        found = [m.group() for m in pattern.finditer(text or "")]
        pieces = pattern.sub("\0", text or "").split("\0")
        shape = re.compile("(.+?)".join(map(re.escape, pieces)), re.S)
        outs = [r for r in by_id[doc_id] if (r.text is None) == (text is None) and shape.fullmatch(r.text or "") and r.n_entities >= len(found)]
        assert outs, text
        if len(outs) > 1 or any(regex.match(r"\p{L}+\.? \p{L}", f) for f in found):
            continue  # names: the tests above
        for was, now in zip(found, shape.fullmatch(outs[0].text or "").groups(), strict=True):
            a, b = (x.lower() if "@" in x else re.sub(r"\D", "", x) if not re.search("[A-Za-z]|\\d\\.\\d", x) else x for x in (was, now))
            assert forward.setdefault(a, b) == b and back.setdefault(b, a) == a and a != b
            assert "." in was and "@" not in was or re.sub(r"\w", "x", was) == re.sub(r"\w", "x", now)
    assert len(forward) >= 110 and not set(forward) & set(back)


def test_surrogates_use_no_python(spark):
    df = replace_entities(spark.createDataFrame(PERSONAL, "doc_id long, text string"), "k")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert PATTERN.startswith("(")


# ------------------------------------------------------------------ packing
def padding_by_force(lengths, buckets):
    kinds = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(kinds)) + 1):
        for cut in itertools.combinations(range(1, len(kinds)), k - 1):
            ends = [*[kinds[c - 1] for c in cut], kinds[-1]]
            cost = sum(min(e for e in ends if e >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    r = random.Random(1)
    for _ in range(60):
        lengths = [r.randint(1, 12) for _ in range(r.randint(1, 30))]
        kinds, counts = np.unique(lengths, return_counts=True)
        k = r.randint(1, 4)
        ends = packing.optimal_boundaries(kinds, counts, kinds * counts, k)
        assert len(ends) <= k and ends[-1] == len(kinds) - 1
        tops = kinds[ends]
        assert sum(int(tops[np.searchsorted(tops, x)]) - x for x in lengths) == padding_by_force(lengths, k)


def packed_rows(docs, **sizes):
    return packing.documents_of(packing.pack(docs, tokenizer_path, **sizes)).collect()


def check_batches(rows, budget):
    """Places of packed rows: a slot for each, batches within the budget, at most
    one of a bucket not full; long sequences alone and unpadded."""
    assert len({(r.batch_id, r.slot) for r in rows}) == len(rows)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
        assert 0 <= r.padding == r.bucket_length - r.length
    for own in batches.values():
        assert len({(r.bucket, r.bucket_length) for r in own}) == 1
        assert len(own) * own[0].bucket_length <= budget or (len(own) == 1 and own[0].padding == 0)
        assert sorted(r.slot for r in own) == list(range(len(own)))
    partly = [own[0].bucket for own in batches.values() if (len(own) + 1) * own[0].bucket_length <= budget]
    assert len(partly) == len(set(partly))
    assert sorted(batches) == list(range(len(batches)))


def test_packed_rows_against_brute_force(spark):
    budget, texts = 300, [(r.doc_id, r.text) for r in cases.documents(spark).collect()]
    rows = packed_rows(cases.documents(spark), buckets=3, token_budget=budget)
    check_batches(rows, budget)
    whole = Tokenizer.from_file(tokenizer_path())
    expected = []
    for i, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, len(ids), zlib.crc32(",".join(map(str, ids)).encode())))
    assert sorted(((r.doc_id, r.length, r.ids_crc32) for r in rows), key=str) == sorted(expected, key=str)
    short = [n for _, n, _ in expected if n <= budget]
    assert len(short) < len(expected)  # one is longer than the budget
    assert sum(r.padding for r in rows) == padding_by_force(short, 3)
    assert packed_rows(cases.empty(spark)) == []


def test_packed_rows_of_one_hot_id(spark):
    docs = spark.createDataFrame([(5 if i % 3 else i, "the same words " * (1 if i % 3 else i % 50)) for i in range(4000)], "doc_id long, text string").repartition(5)
    rows = packed_rows(docs, buckets=4, token_budget=1000)
    assert len(rows) == 4000
    check_batches(rows, 1000)
    sized = packing.tokenized(docs, tokenizer_path).select("row", "length")
    shards = sized.select(F.pmod(F.xxhash64("row"), F.lit(4)).alias("shard")).groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) < 1200


def test_packing_of_long_sequences_only(spark):
    docs = spark.createDataFrame([(i, "word " * 50 * (i + 1)) for i in range(3)], "doc_id long, text string")
    rows = packed_rows(docs, token_budget=20)
    assert [(r.slot, r.padding) for r in rows] == [(0, 0)] * 3 and {r.batch_id for r in rows} == {0, 1, 2}


# ------------------------------------------------------------------ records
HARD = ["it's we've 'll x'd'S ''s 's's don't", "a  b   c\n\n d \n", "  lead", "\t\tx", "日本 한국 é'l 1½", "<|endoftext|> hi", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "|>", "😀 smile's", "\n's", " ", None, ""]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_records_round_trip_against_the_whole_encoder(spark, tokenizer, tmp_path):
    texts = HARD + cases.texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    folder = records.make_folder(str(tmp_path / "rec"))
    manifest = records.write_records(docs, folder, tokenizer_path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in records.read_digests(manifest).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes())), (i, t)
        start += len(ids)
    name = manifest.orderBy("shard").first()["name"]
    first, ids = records.fetch_record(name, 1)
    assert got[first][1] == len(ids)


def test_rows_of_a_hot_id_are_many_shards(spark, tmp_path):
    texts = [f"text {i % 40} of one id" for i in range(3000)]
    docs = spark.createDataFrame([(5 if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    manifest = records.write_records(docs, records.make_folder(str(tmp_path / "hot")), tokenizer_path)
    sizes = [r.n_records for r in manifest.collect()]
    assert sum(sizes) == 3000 and len(sizes) == 4 and max(sizes) < 1200
    got = records.read_digests(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(got))


def test_word_borders_on_random_texts(tokenizer):
    r = random.Random(1)
    letters = list("'srevltmd \n\ta1! ") + ["é", "½", "日", " ", "́"]
    encoder = records.WordEncoder(tokenizer_path())
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(x) for x in raw])
    got = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_damaged_records_are_noticed(tmp_path):
    import io

    good = records.frame(b"payload")
    assert list(records.read_frames(io.BytesIO(good * 2))) == [b"payload"] * 2
    for at in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            list(records.read_frames(io.BytesIO(bytes(bad))))


def test_records_of_nothing(spark, tmp_path):
    folder = records.make_folder(str(tmp_path / "none"))
    assert records.read_digests(records.write_records(cases.empty(spark), folder, tokenizer_path)).count() == 0
