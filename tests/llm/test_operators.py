"""Each operator against a plain version, on few rows that hold nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestat.llm import additive_quantisation as aq
from lodestat.llm import flac, katz, language_id, mixing, packing, pii, queries, sharding, simhash, url_filter
from lodestat.llm.common import local_rows, remainder

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    None, "", "   ", "one", "Two words", "the cat sat on the mat", "The cat sat on the mat", "the cat sat on the mat", "a\tb\x0bc\x1cd\u00a0e",
    "mail bob.smith@mail.example.com now", "ip 10.0.0.255 and 300.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 ok", "call +1 (487) 555-7209 today",
    "+1 (487) 555-7209 4736962573099581 x", "7536784127813050 4845168114407329 two cards", "x" * 3000 + "@a.b", "9" * 2000, "é" * 700 + " ünï cödé 😀 10.1.2.3",
    " ".join(f"w{i % 97}" for i in range(6000)), " ".join(f"w{i % 97}" for i in range(6001)), "der die das und ist nicht ein eine", "le la les et est pas un une", "<|endoftext|> here", "!!! 123",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank long, h long, id long, t string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if t and "der" in t else "fr" if t and "les" in t else "en", [None, "a", "b", "c"][i % 4], len(t or ""), 7, 7, 7, 7, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[5]], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(r):
    return TEXTS[r["doc_id"]] or ""


def test_urls_match_the_rules_in_plain_code(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/en/x", "http://a.Example.com/en/78?q", "https://example.com/en/6", "x://example.net/de/8#f", "x://b.net/de/9", "http://org?/es/", "http://org/es/" + "a" * 5000, "http://notcom/en/", "a://b.c.org/es/://z", "http://com/en/x"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)) + [(4, urls[4])], "page_id int, url string").withColumn("host", F.lit(1)), local_rows(spark, queries.URL_RULES, "action string, host string, path string"))
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOW)
        fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    rows = sorted(tuple(r) for r in got.fillna("-", ["rule"]).collect())
    assert rows == sorted((i, *[x or "-" if k == 2 else x for k, x in enumerate(plain(u))]) for i, u in [*enumerate(urls), (4, urls[4])])
    none = local_rows(spark, "[]", "action string, host string, path string")
    assert {r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame([(1, "http://com/en/")], "page_id int, url string"), none).collect()} == {"allow"}


def test_urls_give_back_every_copy(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "COPIES", 4)
    rules = local_rows(spark, queries.URL_RULES, "action string, host string, path string")
    rows = [(7, "http://com/en/x")] * 9 + [(None, "http://com/en/x")] * 4 + [(None, None)] * 5 + [(8, "http://a.net/de/8")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id int, url string").repartition(3), rules)
    counts = collections.Counter((r["page_id"], r["host"], r["verdict"]) for r in got.collect())
    assert counts == {(7, "com", "block"): 9, (None, "com", "block"): 4, (None, "", "allow"): 5, (8, "a.net", "allow"): 1}
    assert got.where("false").columns == ["page_id", "host", "path", "rule", "verdict"]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id int, url string"), rules).collect() == []


def test_flac_round_trip_and_checksums(spark, docs):
    for r in flac.media_features(flac.with_media(docs)).collect():
        raw = text_of(r).encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    rng = np.random.default_rng(3)
    hard = [rng.integers(0, 256, 192 * 9, dtype=np.uint8).tobytes(), bytes(192), (128 + 100 * np.sin(np.arange(1920) / 9)).astype(np.uint8).tobytes(), b"\x00\xff" * 96, bytes(range(192)) * 300]
    media = flac.encode(hard)
    assert [d for d, _ in flac.decode(media)] == hard
    for at in (-3, -60, len(media[0]) // 2 + 200):
        broken = bytearray(media[0])
        broken[at] ^= 16
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
    blocks = flac.pcm_blocks(flac.with_media(docs), blocks=2).collect()
    by = collections.defaultdict(dict)
    for b in blocks:
        by[b["doc_id"]][b["first_sample"]] = bytes(b["pcm"])
    assert all(b"".join(v[k] for k in sorted(v)).rstrip(b" ") == text_of({"doc_id": i}).encode().rstrip(b" ") for i, v in by.items())
    assert flac.with_media(empty(spark)).count() == 0 and flac.media_features(flac.with_media(empty(spark))).count() == 0
    table = max((r["blocks"] for r in flac.pcm_table(flac.with_media(docs), blocks=3).collect()), key=len)
    table = [b.asDict() for b in table]
    whole = b"".join(b["pcm"] for b in table)
    assert all(flac.read_samples(table, at, 500) == whole[at : at + 500] for at in (0, 1, 575, 576, 577, len(whole) - 500, len(whole) - 20, len(whole)))
    table[1]["pcm"] = table[1]["pcm"][:-1] + b"?"
    with pytest.raises(ValueError):
        flac.read_samples(table, 600, 10)


def test_katz_matches_plain_recursion_and_sums_to_one(spark, docs):
    rows, model = katz.score(docs, remainder(F.col("doc_id"), 7) != 2)
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    tok = {i: [*WORD.findall(text_of({"doc_id": i}).translate(LOW)), None] for i in set(ids)}
    train = [i for i in ids if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in train for w in tok[i])
    n, v = sum(c.values()), len(c)
    pair = collections.Counter(p for i in train for p in zip(["<s>", *tok[i][:-1]], tok[i], strict=True))
    coc = collections.Counter(pair.values())
    d = katz.discounts([coc[i] for i in range(1, 7)])
    under = collections.defaultdict(dict)
    for (h, w), k in pair.items():
        under[h][w] = k

    def p(h, w):
        base = (c[w] + 1) / (n + v + 1)
        if h not in under:
            return base
        seen = under[h]
        kept, total = sum(k * (d[k - 1] if k <= 5 else 1) for k in seen.values()), sum(seen.values())
        total += total - kept <= 0
        if w in seen:
            return seen[w] * (d[seen[w] - 1] if seen[w] <= 5 else 1) / total
        return (1 - kept / total) / (1 - sum((c[x] + 1) / (n + v + 1) for x in seen)) * base

    for h in ("<s>", "the", "w5", "one", "never"):
        assert abs(sum(p(h, w) for w in c) + p(h, "unknown word") - 1) < 1e-9
    for r in rows.collect():
        t = tok[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True)), rel=1e-9)
    assert katz.score(empty(spark), F.lit(True))[0].count() == 0


def base_spans(t):
    pats = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+){3}"), ("card", r"[0-9](?:[ -]?[0-9])+"), ("phone", r"\+[0-9][ ().0-9-]+[0-9]")]

    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        if k == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if k == "card":
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0
        return k == "email" or 9 <= len(d) <= 15

    return [(m.start(), m.end(), k) for _, _, m, k in sorted((m.start(), o, m, k) for o, (k, p) in enumerate(pats) for m in re.finditer(p, t) if ok(k, m.group()))]


def test_pii_base_spans_stay_and_redaction_removes_them(spark, docs):
    model = pii.fit(docs)
    for r in pii.detect(docs, model).collect():
        want = base_spans(text_of(r))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in want) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(r["spans"].split(","))
    for r in pii.redact(docs, None).collect():
        t, want = TEXTS[r["doc_id"]], base_spans(text_of(r))
        end, out = 0, ""
        merged = []
        for a, b, k in want:
            if merged and merged[-1][1] > a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, k])
        for a, b, k in merged:
            out += t[end:a] + f"[{k.upper()}]"
            end = b
        assert r["text"] == (None if t is None else out + t[end:])
    assert pii.fit(empty(spark)) is None and pii.detect(empty(spark), None).count() == 0


def test_cards_of_digits_that_stand_apart_are_base_spans(spark):
    rows = [(1, f"card {' '.join('4' + '1' * 15)} end"), (2, f"card {'-'.join('4' + '1' * 15)} end"), (3, "1 2 3 4 no card")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: (r["n_card"], r["spans"]) for r in pii.detect(docs, None).collect()}
    assert got == {1: (1, "card:5:36"), 2: (1, "card:5:36"), 3: (0, "")}
    assert {r["text"] for r in pii.redact(docs, None).collect()} == {"card [CARD] end", "1 2 3 4 no card"}


def test_trees_find_what_the_base_patterns_miss(spark):
    rows = [(i, f"see 75367841278130{i % 90 + 10} or card 4111111111111111 4845168114407329 and call 10.0.{i % 256}.{i} today") for i in range(400)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id int, text string"))
    got = pii.detect(spark.createDataFrame([(1, "pay 4111111111111111 4845168114407329 now")], "doc_id int, text string"), model).first()
    assert got["n_card"] == 0 and got["spans"] == "card:4:20,card:21:37"


def test_written_out_addresses_and_paired_phones_are_found(spark):
    phones = ["055 123 456", "555.0123.4567", "20 123 123"]
    rows = [(i, f"write {['bob', f'bob{i}'][i % 2]}@mail.example.com or {['look', f'somebodylooked{i}'][i // 2 % 2]} at home.page today, see 4111111111111111 or {7536784127813000 + i} and reach {phones[i % 3]} now") for i in range(400)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id int, text string"))
    hits = ["bob (at) mail (dot) example (dot) com", "bob [at] mail [dot] example [dot] com", "bob(at)mail.example.com", "bob at mail dot example dot com", "01 23 45 67 89", "612 34 56 78", "030-12-34-56-78"]
    texts = [(i, f"write {h}. Then go") for i, h in enumerate(hits)] + [(99, "they look at home.page and stay")]
    got = {r["doc_id"]: r["spans"] for r in pii.detect(spark.createDataFrame(texts, "doc_id int, text string"), model).collect()}
    assert got == {i: f"{'email' if 'bob' in h else 'phone'}:6:{6 + len(h)}" for i, h in enumerate(hits)} | {99: ""}


def test_probabilities_are_pooled_until_they_rise():
    assert pii.isotonic([(0, 0), (1, 4), (0, 0), (0, 4), (3, 4), (0, 0), (4, 4)]) == [0.0, 0.125, 0.125, 0.125, 0.75, 0.75, 1.0]
    assert pii.isotonic([(0, 0)] * 3) == [0.0] * 3


def test_added_spans_match_a_plain_choice(spark, docs):
    rows = [(i, f"see 75367841278130{i % 90 + 10} or card 4111111111111111 4845168114407329, call +1 (487) 555-7{i % 900 + 100} at 10.0.{i % 256}.{i % 200} or b{i}@mail.example.com") for i in range(300)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id int, text string"))
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = F.transform(pii.candidates(text), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.struct(*[v.alias(k) for k, v in pii.features(x["kind"], x["hit"], x["before"], x["after"]).items()]).alias("f")))
    told = docs.select("doc_id", F.transform(seen, lambda x: F.struct(x["kind"], x["s"], x["e"], pii.probability(model, {k: x["f"][k] for k in model["names"]}).alias("p"))).alias("c"))
    good = {r["doc_id"]: [(a, pii.KINDS.index(k), b) for k, a, b, p in r["c"] if p >= model["thresholds"][k]] for r in told.collect()}
    for r in pii.detect(docs, model).collect():
        base = [(a, pii.KINDS.index(k), b) for a, b, k in base_spans(text_of(r))]
        taken = []
        for a, o, b in sorted(good[r["doc_id"]]):
            if all(y <= a or b <= x for x, _, y in base + taken):
                taken.append((a, o, b))
        assert r["spans"] == ",".join(f"{pii.KINDS[o]}:{a}:{b}" for a, o, b in sorted(base + taken))


def test_many_hits_in_one_text(spark):
    text = " ".join(f"é10.0.{i % 256}.{i % 7} up" for i in range(100_000))
    got = pii.redact(spark.createDataFrame([(1, text, "x")], "doc_id int, text string, __all string"), None).first()
    assert got["text"] == re.sub(r"[0-9.]+", "[IP]", text) and got["__all"] == "x"


def test_thresholds_come_from_all_candidates(spark, monkeypatch):
    rows = [(i, f"see 75367841278130{i % 90 + 10} or card 4111111111111111 4845168114407329" + " ip 10.0.0.1 up" * (i >= 300)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    hashes = {r["doc_id"]: r["k"] % (1 << 30) for r in docs.selectExpr("doc_id", "xxhash64(cast(doc_id as string), 'pii') as k").collect()}
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 100)
    limit = 100 / 400 * (1 << 30)
    docs = docs.where(~F.col("doc_id").isin([i for i, h in hashes.items() if i >= 300 and h < limit]))  # no document of the sample holds an address
    model = pii.fit(docs)
    assert model["thresholds"]["ip"] != 0.9


def test_mix_reaches_targets(spark, docs):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r["size"] == len(WORD.findall(text_of(r))) and r["taken"] <= 2 * r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[[None, "a", "b", "c"][r["doc_id"] % 4]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {k: sum(r["size"] for r in v) for k, v in by.items()}
    w = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, free, target = 1.5 * sum(size.values()), set(names), {}
    while over := [k for k in free if left * w[k] / sum(w[j] for j in free) > 2 * size[k]]:
        for k in over:
            target[k] = 2.0 * size[k]
            left -= target[k]
            free.discard(k)
    target |= {k: left * w[k] / sum(w[j] for j in free) for k in free}
    for k, v in by.items():
        assert all(r["source_size"] == size[k] and r["target"] == pytest.approx(target[k]) for r in v)
        assert abs(sum(r["taken"] for r in v) - target[k]) <= max(r["size"] for r in v)
    assert sorted(map(tuple, mixing.plan_mix(docs.repartition(5)).select("doc_id", "taken").collect())) == sorted((r["doc_id"], r["taken"]) for r in rows)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter({r["doc_id"]: 0 for r in rows}) + collections.Counter(x for r in rows for x in [r["doc_id"]] * len(r["draws"]))
    assert mixing.plan_mix(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    # Every source's draws of whole blocks reach the shards in the numbers that the tree has dealt.
    seen = collections.defaultdict(set)
    for r in rows:
        for at, d in enumerate(r["draws"]):
            seen[[None, "a", "b", "c"][r["doc_id"] % 4]].add((at, d["shard"]))
    assert all(0 <= s < mixing.SHARDS for v in seen.values() for _, s in v)
    quotas = mixing.split_quotas([1000, 10, 0, 333], 7, 1)
    assert [sum(q) for q in quotas] == [1000, 10, 0, 333] and max(map(sum, zip(*quotas, strict=True))) - min(map(sum, zip(*quotas, strict=True))) <= 1


def test_equal_rows_without_ids_are_taken_in_part(spark):
    rows = [(None, "a b c", "x")] * 50 + [(None, f"w{i} b", "x") for i in range(30)] + [(i, "one two", "y") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == len(rows) and all(0 <= r["target"] - r["t"] <= 3 for r in got)
    assert mixing.mix(docs).count() == mixing.plan_mix(docs).select(F.sum(F.size("draws"))).first()[0]


def test_a_giant_document_leaves_its_source_no_shorter_than_the_smallest_left(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 2000)
    # Every second of three sources is half a giant; the others are small and used twice, so it has to give 1.3 times its words.
    rows = [(s * 1000 + i, "w " * (27_000 if s % 3 == 1 and i == 0 else 40 + i % 3), f"s{s:02}") for s in range(12) for i in range(660 if s % 3 == 1 else 264)]
    by = collections.defaultdict(list)
    for r in mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        by[r["doc_id"] // 1000].append(r)
    for v in by.values():
        times = max(len(r["draws"]) for r in v)
        short = v[0]["target"] - sum(r["taken"] for r in v)
        smallest = min((r["size"] for r in v if len(r["draws"]) < times), default=1)
        assert times <= mixing.MOST and 0 <= short < smallest


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * (i % 50)) for i in range(3000)] + [(3000, None), (7, "again")]
    got = sharding.shard_by_ranges(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")), 40).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert len(got) == len(rows) and set(by) == set(range(40))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    size = [sum(r["size"] for r in v) for v in by.values()]
    assert max(size) - min(size) <= 2 * max(r["size"] for r in got)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.shard_by_ranges(empty(spark), 40).count() == 0


def test_equal_texts_share_a_shard_and_huge_groups_are_cut(spark):
    rows = [(i, f"group {i % 700} " * 4) for i in range(7000)] + [(i, "hot " * 30) for i in range(7000, 11000)] + [(None, None)] * 500
    got = sharding.shard_by_ranges(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    by, size = collections.defaultdict(collections.Counter), collections.Counter()
    for r in got:
        by[(r["text_crc32"], r["size"])][r["shard"]] += 1
        size[r["shard"]] += r["size"]
    fair = sum(size.values()) / 10
    assert len(got) == len(rows) and set(size) == set(range(10))
    for (_, n), v in by.items():
        assert len(v) == 1 or n * sum(v.values()) > sharding.TOLERANCE * fair
    assert max(size.values()) - min(size.values()) <= 2 * sharding.TOLERANCE * fair + 200


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "KEYS_PER_RANGE", 1)  # a poor first sample
    rows = spark.range(20_000).selectExpr("concat(lpad(hex(xxhash64(if(id % 3 = 0, 0, id))), 16, '0'), lpad(hex(xxhash64(id)), 16, '0'), lpad(hex(id), 16, '0')) as __key", "100L as size")
    found = sharding.splitters_of(rows, 50, 2_000_000)
    most = rows.groupBy(sharding._range_of(F.col("__key"), found).alias("r")).agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 4 * 2_000_000 / 50 and sharding.quantiles([], 5) == []


def test_language_is_learned_from_labels(spark, docs):
    say = {"en": "the house and the garden with that which is there", "de": "das haus und der garten mit dem was dort ist", "fr": "la maison et le jardin avec ce qui est ici"}
    rows = [(i, " ".join(say[k].split()[(i * 7 + j * 3) % 10] for j in range(30)), k) for i in range(60) for k in say]
    known = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 30)
    got = language_id.identify(spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] >= 30], "doc_id long, text string"), known).collect()
    assert sum(g["lang_pred"] == r[2] for g, r in zip(sorted(got), sorted((r[0], g2["lang_pred"], r[2]) for r, g2 in zip([r for r in rows if r[0] >= 30], got, strict=True)), strict=True)) >= 0.9 * len(got)
    for r in language_id.identify(docs, known).collect():
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text_of(r)))) and 0 <= r["score"] <= 1
    # Brute force: a plain compressor for each language, its dictionary of whole texts, on every text.
    import zstandard as z

    first = collections.Counter(r[2] for r in rows if r[0] < 30)
    assert set(known) == set(first) and all(b"  " not in v and len(v) <= language_id.DICT_BYTES for v in known.values())
    plain = {k: z.ZstdCompressor(level=language_id.LEVEL, dict_data=z.ZstdCompressionDict(v.ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k, v in known.items()}
    for g, r in zip(sorted(got), sorted((r[0], r[1]) for r in rows if r[0] >= 30), strict=False):
        if not g["rejected"] and g["score"] > 0.5:
            data = language_id.letters({(x[0], x[2]): x[1] for x in rows}[g["doc_id"], g["lang_pred"]])
            assert min((len(c.compress(data)), k) for k, c in plain.items())[1] == g["lang_pred"]
    long = language_id.Classifier(known).judge(" ".join(t for _, t, k in rows if k == "de") * 3)
    assert long[0] == "de" and not long[2]
    one = language_id.learn(spark.createDataFrame([(1, "ab " * 60_000, "xx"), (2, "cd " * 50_000, "xx")], "doc_id long, text string, lang string"), F.lit(True))
    assert one == {"xx": b" ".join([b"cd"] * 50_000)}
    with pytest.raises(ValueError):
        language_id.learn(spark.range(400).selectExpr("id as doc_id", "'a' as text", "cast(id as string) as lang"), F.lit(True))
    assert language_id.learn(empty(spark), F.lit(True)) == {} and language_id.identify(empty(spark), known).count() == 0


def test_pieces_cover_every_document(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for v in seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert set(by) == set(range(len(TEXTS)))
    for i, v in by.items():
        ids = np.array([*tok.encode(TEXTS[i] or "", add_special_tokens=False).ids, 0], "<u4")
        times = 2 if i == 5 else 1
        assert sum(r["length"] for r in v) == times * len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in v)
    assert packing.pack(empty(spark)).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(5)
    for lengths, bound in ((np.minimum(rng.lognormal(5, 0.8, 50_000).astype(int) + 1, 1024), 1.001), (rng.integers(300, 700, 50_000), 1.01), (np.full(999, 400), 1.29), (np.array([1, 1024, 3]), 2)):
        demand = collections.Counter(lengths.tolist())
        plan = packing.cutting_stock(demand, 1024)
        assert all(sum(s * a for s, a in p.items()) <= 1024 for p, _ in plan)
        assert all(sum(p.get(s, 0) * k for p, k in plan) >= n for s, n in demand.items())
        assert sum(k for _, k in plan) <= bound * sum(s * n for s, n in demand.items()) / 1024 + 1
    assert packing.cutting_stock({}, 1024) == []


def test_patterns_improve_on_largest_first():
    # Largest first gives 7 + 2 and wastes; 4 + 6 and 7 + 3 fill the room.
    demand = {7: 1000, 6: 1000, 4: 1000, 3: 1000, 2: 10}
    assert sum(k for _, k in packing.cutting_stock(demand, 10)) <= 2003


def test_the_solver_runs_in_a_process_that_has_packed(spark, docs):
    assert packing.pack(docs).count() > 0
    a = np.random.default_rng(1).normal(size=(120, 120))
    assert np.abs((packing._inverse(a)[:, :, None] * a[None]).sum(axis=1) - np.eye(120)).max() < 1e-6


def test_ids_are_those_of_the_tokenizers_file_on_whole_documents():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    slow, fast = Tokenizer.from_file(packing.default_tokenizer()), packing.Tokens(packing.default_tokenizer())
    assert all(slow.encode(t, add_special_tokens=False).ids == fast(t) for t in texts if t)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    x[100:400] = x[100]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3020, [None] + [1.0] * 15)]
    got = collections.defaultdict(list)
    for r in aq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))).collect():
        got[r["query_id"]].append(r)
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    for q, v in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        v.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in v] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in v)
        assert [(-r["score"], r["vec_id"]) for r in v] == sorted((-r["score"], r["vec_id"]) for r in v)
        hit += len({r["vec_id"] for r in v} & set(np.lexsort((np.arange(3000), -np.round(s, 9)))[:20].tolist()))
    assert hit >= 0.9 * 20 * len(got)
    assert aq.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_recall_over_several_blocks_with_copies(spark, monkeypatch):
    monkeypatch.setattr(aq, "ROWS", 1500)
    monkeypatch.setattr(aq, "RERANKED", 60)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32)) * np.where(np.arange(6000) % 7 == 0, 1e25, 1)[:, None]
    x[1000:3000] = x[1000]
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(2)
    got = collections.defaultdict(set)
    for r in aq.search(rows).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q, v in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(v & set(np.lexsort((np.arange(6000), -s))[:20].tolist()))
    assert len(got) == 300 and hit >= 0.9 * 20 * len(got)


def test_only_copies_that_cannot_win_are_left_out():
    x = np.array([[1.0, 2], [3, 4], [1, 2], [1, 2], [3, 4], [5, 6]])
    assert aq._first_copies(x, 2).tolist() == [0, 1, 2, 4, 5]


def plain_fingerprint(t):
    w = [x.translate(LOW) for x in WORD.findall(t)]
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots_of(fps):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_groups(spark, docs):
    fp = {i: plain_fingerprint(t or "") for i, t in enumerate(TEXTS)}
    root = roots_of(set(fp.values()))
    least = {}
    for i in sorted(fp):
        least.setdefault(root[fp[i]], i)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    assert all(r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == least[root[fp[r["doc_id"]]]] for r in rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("crowded", [100_000, 100])
def test_crowded_keys_lose_no_link(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(2)
    some = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for x in list(some)[:3]:
        some |= {x ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))}
    want = roots_of(some)
    got = dict(map(tuple, simhash.components(simhash.links(spark.createDataFrame([(x,) for x in some], "fp long"))).collect()))
    assert all(got.get(x, x) == want[x] for x in some)


@pytest.fixture(scope="module")
def table(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit("k").alias("row"), F.lit("h").alias("h")).cache()


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_dedup_stage_keeps_one_row_of_each_group(spark, table):
    import corpus_pipeline

    more = [(3, "another text of number three", "en", "a", 1, "k", "h"), (None, "one", "en", "b", 3, "k", "h"), (None, "alone without id", "en", "b", 3, "k", "h"), (None, "alone without id", "en", "b", 3, "k", "h"), (77, None, "de", None, 0, "k", "h")]
    rows = [tuple(r) for r in table.collect()] + more
    groups = roots_of({plain_fingerprint(r[1] or "") for r in rows})
    want = {}
    for r in rows:
        g = groups[plain_fingerprint(r[1] or "")]
        rank = (r[0] is None, r[0] or 0)
        if g not in want or rank < want[g][0]:
            want[g] = (rank, {r})
        elif rank == want[g][0]:
            want[g][1].add(r)
    got = rows_of(corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, table.schema).repartition(3), ""))
    assert sum(got.values()) == len(want) and set(got.values()) == {1}
    assert all(len(set(got) & some) == 1 for _, some in want.values())


def test_language_stage_keeps_whole_rows(spark, table):
    import corpus_pipeline

    known = language_id.Classifier(language_id.learn(table, F.lit(True)))
    want = collections.Counter(tuple(r) for r in table.collect() if not known.judge(r["text"])[2])
    assert rows_of(corpus_pipeline.identify_language(spark, table, "")) == want and sum(want.values())


def test_redaction_stage_replaces_spans(spark, table):
    import corpus_pipeline

    found = {r["doc_id"]: r["spans"] for r in pii.detect(table, pii.fit(table)).collect()}
    for r in corpus_pipeline.redact_personal_data(spark, table, "").collect():
        before = TEXTS[r["doc_id"]]
        out, end, merged = "", 0, []
        for k, a, b in (x.split(":") for x in found[r["doc_id"]].split(",") if x):
            if merged and merged[-1][1] > int(a):
                merged[-1][1] = max(merged[-1][1], int(b))
            else:
                merged.append([int(a), int(b), k])
        for a, b, k in merged:
            out, end = out + before[end:a] + f"[{k.upper()}]", b
        assert r["text"] == (None if before is None else out + before[end:]) and r["n_chars"] == (None if before is None else len(r["text"])) and r["row"] == "k"


def test_pipeline_stages(spark, table, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "pii", "mixing", "packing"]
    plain = table.drop("row", "h")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, plain, "").collect()}
    assert pieces and {r["doc_id"] for r in pieces} <= kept
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, plain.limit(0), "")
        assert none.columns == plain.columns and none.count() == 0, name
    assert corpus_pipeline.pack_sequences(spark, plain.limit(0), "").count() == 0


def test_language_is_learned_beside_very_many_copies(spark):
    copies = spark.range(200_000).selectExpr("cast(7 as long) as doc_id", "'the and of with you are' as text", "'en' as lang")
    few = spark.createDataFrame([(i + 10, f"der die das und nicht ein {i}", "de") for i in range(50)], "doc_id long, text string, lang string")
    known = language_id.learn(copies.unionByName(few), F.lit(True))
    assert list(known) == ["en", "de"] and known["en"] == b"the and of with you are" and known["de"].count(b"der die das") == 50
    only = language_id.learn(copies.where("text = ''").unionByName(few.limit(1)), F.lit(True))
    assert list(only) == ["de"]


def test_one_ragged_vector_does_not_empty_a_search(spark):
    rng = np.random.default_rng(1)
    rows = [(0, [1.0, 2.0])] + [(i, rng.normal(size=3).tolist()) for i in range(1, 100)]
    got = aq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert {r["query_id"] for r in got} == {20, 40, 60, 80} and 0 not in {r["vec_id"] for r in got}
    tie = [(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])]
    assert [r["id"] for r in aq.usable(spark.createDataFrame(tie, "vec_id long, embedding array<double>")).collect()] == [2]


def test_names_with_dots_and_clashes_stay(spark):
    import corpus_pipeline

    rows = [(i, f"the cat and the dog of {i} are with you", "en", "a", 1, 2) for i in range(30)] + [(i + 50, f"der hund und die katze {i} nicht ein", "de", None, 1, 2) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` int, `row` int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0


def test_equal_texts_share_a_shard_unless_they_are_large(spark):
    rows = [(i, "a" * 400) for i in range(2)] + [(i + 10, f"text {i} " * 8) for i in range(300)] + [(i + 1000, "b" * 50) for i in range(4)] + [(i + 2000, "hot " * 5) for i in range(2000)]
    got = [tuple(r) for r in sharding.shard_by_ranges(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).select("doc_id", "shard", "size").collect()]
    of, sizes = {i: s for i, s, _ in got}, collections.Counter()
    for _, s, n in got:
        sizes[s] += n
    assert of[0] == of[1] and len({of[1000 + i] for i in range(4)}) == 1 and len({of[2000 + i] for i in range(2000)}) > 3
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 2 * 2 * 416


def test_hot_keys_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 5)
    texts = ["", None, "  "] * 20 + [f"a b c d e f g {i % 3}" for i in range(60)] + [f"some other words {i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(simhash, "CROWDED", 100_000)
    assert got == {tuple(r) for r in simhash.near_duplicates(docs).collect()} and len(got) == len(texts)


def test_equal_rows_are_dealt_to_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    docs = spark.range(200).selectExpr("cast(null as long) as doc_id", "'one and the same text' as text")
    got = packing.pack(docs).collect()
    assert len(got) == 200 and len({(r["sequence_id"], r["offset"]) for r in got}) == 200
