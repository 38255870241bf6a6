"""What the methods add to the contracts, on small tables and against plain versions."""

import math
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, graph, licenses, media_audio, minhash, mixing, quality, secrets, warc
from siltstone.llm.shared import saved
from tests.conftest import SF
from tests.llm import helpers as H


# media


def test_wav_and_tensors_round_trip():
    raw = bytes(range(256)) * 40
    stored = media_audio.to_wav(raw)
    assert media_audio.from_wav(stored).tobytes() == raw
    with pytest.raises(ValueError):
        media_audio.from_wav(stored[:-1])
    mels, energy = media_audio.log_mel(media_audio.resample(media_audio.from_wav(stored)))
    table = media_audio.from_tensors(media_audio.to_tensors(mels))
    held = np.concatenate([np.array(x.as_py()).reshape(media_audio.FRAMES, media_audio.MELS)[: n.as_py()] for x, n in zip(table.column("log_mel").combine_chunks().storage if hasattr(table.column("log_mel").combine_chunks(), "storage") else table.column("log_mel").chunk(0).storage, table.column("frames"), strict=True)])
    assert np.array_equal(held.astype(np.float32), mels) and len(energy) == len(mels)


def test_resampling_keeps_a_low_tone_and_drops_a_high_one():
    t = np.arange(20_000) / media_audio.RATE
    tone = lambda f: (128 + 100 * np.sin(2 * np.pi * f * t)).astype(np.uint8)
    low, high = (media_audio.resample(tone(f))[500:-500] for f in (500, 7000))
    assert len(media_audio.resample(tone(500))) == 8000
    assert np.abs(low).max() == pytest.approx(100 / 128, abs=0.03) and np.abs(high).max() < 0.03
    want = 100 / 128 * np.sin(2 * np.pi * 500 * np.arange(8000) / 8000)[500:-500]
    assert np.abs(low - want).max() < 0.03


def test_blocks_do_not_change_features(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8)
    whole = media_audio.resample(x)
    monkeypatch.setattr(media_audio, "_ROWS", 7)
    assert np.allclose(media_audio.resample(x), whole, atol=1e-6)


@pytest.mark.parametrize("n", [64, 256, 257, 700, 1000])
def test_log_mel_against_a_direct_transform(n):
    sound = np.random.default_rng(n).normal(size=n).astype(np.float32)
    mels, energy = media_audio.log_mel(sound)
    width, hop = media_audio.WIDTH, media_audio.HOP
    starts = list(range(0, max(n - width, 0) + hop if n > width else 1, hop))
    starts = [s for s in starts if s == 0 or s + width - hop < n]
    assert len(mels) == len(energy) == len(starts)
    t, f = np.arange(width), np.arange(width // 2 + 1)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * t / width)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = hz(np.linspace(2595 * np.log10(1 + 60 / 700), 2595 * np.log10(1 + 4000 / 700), media_audio.MELS + 2))
    for k, s in enumerate(starts):
        x = np.zeros(width)
        x[: len(sound[s : s + width])] = sound[s : s + width]
        x *= hann
        power = np.abs(np.exp(-2j * np.pi * np.outer(f, t) / width) @ x) ** 2
        for m in range(media_audio.MELS):
            weight = np.interp(f * 8000 / width, edges[m : m + 3], [0, 1, 0], left=0, right=0)
            assert mels[k, m] == pytest.approx(10 * np.log10(max(weight @ power, 1e-8)), abs=0.02)
        assert energy[k] == pytest.approx(10 * np.log10(max((x * x).sum(), 1e-8)), abs=0.02)


def test_segments_against_a_plain_machine():
    rng = np.random.default_rng(6)
    for _ in range(50):
        level = rng.normal(scale=0.5, size=60).astype(np.float32)
        middle, on, want, begin = np.median(level), False, [], 0
        for i, x in enumerate([*level, -np.inf]):
            if not on and x >= middle + media_audio.ON_DB:
                on, begin = True, i
            elif on and x <= middle + media_audio.OFF_DB:
                on = False
                want.append((begin, i))
        second = media_audio.HOP / 8000
        got = [(round(a / second), round((b - media_audio.WIDTH / 8000) / second) + 1) for a, b in media_audio.segments(level)]
        assert got == want


def test_hysteresis():
    level = np.zeros(100, np.float32)
    level[20:40], level[30], level[60] = 5, 0.1, 0.1  # a dip between the levels doesn't end a segment, nor does a small rise begin one
    assert len(media_audio.segments(level)) == 1


# quality


def fast_mcd(x, starts, seed=0):
    """Centre and covariance by random subsets and exact concentration steps, as FAST-MCD does it."""
    rng, (n, p) = np.random.default_rng(seed), x.shape
    h, best = math.ceil(n * quality.SHARE), None
    ridge = np.eye(p) * quality.RIDGE**2
    for _ in range(starts):
        subset, last = rng.choice(n, p + 1, replace=False), None
        for _ in range(100):
            mean = x[subset].mean(0)
            cov = np.cov(x[subset].T, bias=True) * quality.CONSISTENT + ridge
            now = np.linalg.slogdet(cov)[1]
            if last is not None and now >= last - 1e-9:
                break
            last = now if len(subset) == h else None  # the first few points have a smaller one
            d = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
            subset = np.argsort(d, kind="stable")[:h]
        if best is None or last < best[0]:
            best = (last, mean, cov)
    return best


def test_mcd_against_independent_fast_mcd(spark, monkeypatch):
    monkeypatch.setattr(quality, "PRIOR", 0)
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").where("lang in ('en', 'de')").withColumn("source", F.lit("one"))
    stats = saved(quality._raws(quality.text_statistics(docs), "lang", "source"))
    centers, estimates = quality.fit(stats)
    found = {r.g_lang: r for r in estimates.collect()}
    rows = [r for r in quality._vector(stats.where("not base_failed"), centers).collect()]
    for lang in ("en", "de"):
        x = np.array([[r[s] for s in quality.STATS] for r in rows if r.g_lang == lang], float)
        least, mean, cov = fast_mcd(np.unique(x, axis=0), starts=25)
        factor = np.zeros((4, 4))
        for k, (i, j) in enumerate(quality._PAIRS):
            factor[i, j] = found[lang].l[k]
        # as good an ellipsoid: its volume is within 10 % of the least of many random starts, and verdicts agree
        assert np.log(np.diag(factor)).sum() <= least / 2 + 0.1
        z = np.linalg.solve(factor, (x - np.array(found[lang].m)).T)
        got, want = (z * z).sum(0), np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
        assert np.mean((got <= quality.CUTOFF) == (want <= quality.CUTOFF)) > 0.98


def test_every_row_has_a_distance_and_groups_differ(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = quality.judge(docs).collect()
    assert all((r.distance is None) == r.base_failed and (r.base_failed or r.kept == (r.distance <= quality.CUTOFF)) for r in rows)
    stats = saved(quality._raws(quality.text_statistics(docs), "lang", "source"))
    _, estimates = quality.fit(stats)
    factors = [r.l for r in estimates.collect()]
    assert len(factors) == docs.select("lang", "source").distinct().count()
    for i in range(4):
        diagonal = [f[quality._AT[i, i]] for f in factors]
        assert max(diagonal) > 1.2 * min(diagonal) and min(diagonal) > 2 * quality.RIDGE


def test_many_copies_are_one_observation(spark):
    def text(i):
        return " ".join(f"word{(i * 131 + j * 17) % 900 + 100}," if (i + j) % 7 == 0 else f"Word{(i * 31 + j * 19) % 900 + 10 ** (j % 4)}" for j in range(60 + i % 20))

    rows = [(i, text(i), "en", "s") for i in range(80)] + [(1000 + i, text(5), "en", "s") for i in range(400)]
    assert all(r.kept for r in quality.judge(H.frame(spark, rows)).collect())


def test_outliers_go_and_clean_rows_stay(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j * 13) % 501}" for j in range(60 + i % 30)), "en", "s") for i in range(200)]
    bad = [(1000 + i, " ".join(f"w###{(i * 5 + j * 11) % 97}$$$" for j in range(60)), "en", "s") for i in range(10)]
    kept = {r.doc_id for r in quality.keep_good(H.frame(spark, clean + bad)).collect()}
    assert kept == set(range(200))
    assert quality.keep_good(H.frame(spark, clean)).columns == H.frame(spark, clean).columns


def plain_text(i, n=100, word="word"):
    w = [f"{word}{(i * 131 + j * 17) % 900 + 100}" for j in range(n + i % 9)]
    w = [x.capitalize() if (i + j) % 9 == 0 else x + "," if (i * 3 + j) % 8 == 0 else x for j, x in enumerate(w)]
    return "\n".join(" ".join(w[j : j + 10]) for j in range(0, len(w), 10))


def test_each_statistic_rejects_alone(spark):
    own = plain_text(7)
    few = [f"thing{j}" for j in range(400, 425)]
    alone = {
        "word_length": own.replace("word", "longlongword").replace("Word", "Longlongword"),
        "punctuation": own.replace("word", "w##d"),
        "capitals": own.replace("word", "WORD"),
        "variety": "\n".join(" ".join(w.capitalize() if (j + k) % 9 == 0 else w + "," if (j + k) % 8 == 0 else w for k, w in enumerate(few[j % 5 :: 3])) for j in range(13)),
    }
    clean = [(i, plain_text(i + 10), "en", "s") for i in range(150)]
    rows = {r.doc_id: r for r in quality.judge(H.frame(spark, clean + [(1000 + i, t, "en", "s") for i, t in enumerate(alone.values())])).collect()}
    assert sum(rows[i].kept for i in range(150)) >= 148
    for i, name in enumerate(alone):
        assert not rows[1000 + i].base_failed and not rows[1000 + i].kept, name


def test_small_groups_are_judged(spark):
    many = [(i, plain_text(i), "en", "big") for i in range(150)]
    odd = plain_text(2).replace("word", "w#$#")
    few = [(200, plain_text(201), "en", "tiny"), (201, odd, "en", "tiny"), (202, plain_text(203), "xx", "tiny"), (203, odd, "xx", "tiny"), (204, odd, None, None)]
    rows = {r.doc_id: r for r in quality.judge(H.frame(spark, many + few)).collect()}
    assert [rows[i].kept for i in range(200, 205)] == [True, False, True, False, False]
    good = {r.doc_id for r in quality.keep_good(H.frame(spark, many + few)).collect()}
    assert good == {i for i in rows if rows[i].kept}


# secrets


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('db_password: str = "hunter2-very-long-9"', ["hunter2-very-long-9"]), ('x = "Zq8-hT5_wer9kk"\napi_secret = x', ["Zq8-hT5_wer9kk"]), ('{"client_secret": "aB3dE6gH9jK2"}', ["aB3dE6gH9jK2"]), ('part = "s3cr3t-"\ntoken_value = part + "Wx9Lm4Qp"', ["Wx9Lm4Qp"]),
        ("export AUTH_TOKEN='p9X-4tYu-77aa'", ["p9X-4tYu-77aa"]), ("A=Kx8vQ2mN5zR7\nMY_API_KEY=$A", ["Kx8vQ2mN5zR7"]), ('password_hint = "my first dog was brown"', []), ('secret = "changeme-please-1"', []), ("password = getpass('x')", []), ("the token: a word of prose that goes on", []), ("title = 'Zq8-hT5_wer9kk'", []),
        ('password = """Zq8-hT5_wer9kk"""', ["Zq8-hT5_wer9kk"]), ('password = r"Zq8-hT5_wer9kk"', ["Zq8-hT5_wer9kk"]), ('base="Zq8-hT5_wer9kk"\npassword = f"{base}-x"', ["Zq8-hT5_wer9kk"]), ('password = ("Zq8-hT5_w"\n   "erTy12kk-0")', ["Zq8-hT5_w", "erTy12kk-0"]), ('<add key="password" value="Zq8-hT5_wer9kk"/>', ["Zq8-hT5_wer9kk"]),
        ("a:\n  password: |\n    Zq8-hT5_wer9kk\n    2nd-Line_of_1t\n\n  next: x", ["Zq8-hT5_wer9kk\n    2nd-Line_of_1t"]), ('#define PASSWORD "Zq8-hT5_wer9kk"', ["Zq8-hT5_wer9kk"]), ("ENV DB_PASSWORD Zq8-hT5_wer9kk", ["Zq8-hT5_wer9kk"]), ('x = os.getenv("API_TOKEN", "Zq8-hT5_wer9kk")', ["Zq8-hT5_wer9kk"]), ('password = os.environ.get("X", "Zq8-hT5_wer9kk")', ["Zq8-hT5_wer9kk"]),
        ('b = "Zq8-hT5_wer9kk"\ntoken = b + "x"', ["Zq8-hT5_wer9kk"]), ("url: https://user:pw@host token: Zq8-hT5_wer9kk", ["Zq8-hT5_wer9kk"]), ("note: password=Zq8-hT5_wer9kk", ["Zq8-hT5_wer9kk"]), ('a = "Zq8-hT5_wer9kk"\nb = a\nsecret = b', ["Zq8-hT5_wer9kk"]), ("password: |\n", []), ('password = """', []), ("password = (", []),
    ],
)
def test_lexer(text, found):
    assert [text[s:e] for s, e, _ in secrets.lexed(text)] == found


def test_names_are_found_at_any_distance():
    value = '"hunter2-very-long-9"'
    for text in (f"db_password{' ' * 5000}= {value}", f"{'x' * 500}_password = {value}"):
        assert [text[s:e] for s, e, _ in secrets.lexed(text)] == [value[1:-1]]


def program(rng):
    """A program of assignments, and by its literals the names that each reaches, by expanding every value."""
    lines, values, reach = [], {}, {}
    for n in range(rng.integers(3, 25)):
        name = str(rng.choice(["alpha", "beta", "gamma", "db_password", "auth_token", "api_key_id", "delta", "client_secret"])) + str(rng.integers(0, 4))
        parts, held = [], []
        for _ in range(rng.integers(1, 4)):
            known = [k for k in values if k != name]
            if known and rng.random() < 0.6:
                other = str(rng.choice(known))
                parts.append(other)
                held += values[other]
            else:
                literal = f"v{n}-" + "".join(rng.choice(list("abcXYZ019_"), 12))
                parts.append(f'"{literal}"')
                held.append(literal)
        lines.append(f"{name} = " + " + ".join(parts))
        values[name] = held
        for x in held:
            reach.setdefault(x, []).append((name, held))
    return "\n".join(lines) + "\n", reach


def test_lexer_against_expanded_programs():
    rng = np.random.default_rng(4)
    for _ in range(300):
        text, reach = program(rng)
        want = {}
        for x, targets in reach.items():
            worth = max(secrets.name_score(n) * max(secrets.value_score(x), secrets.value_score("".join(held)) if len(held) > 1 else 0) for n, held in targets)
            if worth >= secrets.THRESHOLD:
                want[x] = worth
        got = {text[s:e]: v for s, e, v in secrets.lexed(text)}
        assert set(got) == set(want)
        assert all(got[x] == pytest.approx(want[x], abs=1e-3) for x in got)


def test_chained_assignments_take_linear_time():
    def chain(n):
        return 'a0 = "Zq8-hT5_wer9kk"\n' + "".join(f"a{i} = a{i - 1} + a{i - 1}\n" for i in range(1, n)) + f"password = a{n - 1}\n"

    text = chain(10_000)
    began = time.perf_counter()
    assert [text[s:e] for s, e, _ in secrets.lexed(text)] == ["Zq8-hT5_wer9kk"]
    assert time.perf_counter() - began < 5  # about half a second; doubling values would never end


@pytest.mark.parametrize("unit", ["a:", "a=", "a:'", 'a:"', 'a="', "'\":=`", "x = 'p=' + ", "a: b = ", "a:b:c=d ", 'token="""', "password: |\n", "$a=$b:", 'k = f("x", ', 'getenv("a", ', 'key="a" value=', "f'{a}'=", "a:\\", 'a=("x" ', '"a":[', "日:", "a = a + a\n", "ENV A ENV "])
def test_marks_in_a_row_take_linear_time(unit):
    def took(size):
        text = unit * (size // len(unit)) + "b x"
        began = time.perf_counter()
        secrets.scan(text)
        return time.perf_counter() - began

    assert took(1_000_000) < 8  # a second or two; with the square of the marks it would be a day


def test_redaction(spark):
    rows = [(0, 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b', "en", "s"), (1, None, "en", "s"), (2, "clean text", "en", "s")]
    out = {r.doc_id: r for r in secrets.redact_secrets(H.frame(spark, rows), length_col="n_chars").collect()}
    assert out[0].text == 'a token = "[SECRET]" b' and out[0].n_chars == len(out[0].text) and out[1].text is None and out[2].text == "clean text"
    assert secrets.scan(out[0].text) == []


# chat


def test_every_participant_has_a_perspective(spark):
    said = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello é"), (1, 3, "ann", "Bye"), (1, 3, "ann", "Bye"), (2, 0, "system", "only"), (None, 0, None, None)]
    rows = chat.render_perspectives(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()
    got = {(r.conv_id, r.perspective): r for r in rows}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = got[1, "ann"]
    assert ann.rendered == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=bob|>\nHello é<|end|>\n<|assistant|>\nBye<|end|>\n"
    assert [ann.rendered[m.start : m.end] for m in ann.masks] == ["Hi<|end|>", "Bye<|end|>"]


def test_long_dialogues_come_in_parts(spark):
    said = [(1, t, "ann" if t % 2 else "bob", f"turn {t}") for t in range(25)]
    table = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    whole = {r.perspective: r for r in chat.render_perspectives(table).collect()}
    parts = sorted(chat.render_perspectives(table, part=10).collect(), key=lambda r: (r.perspective, r.part))
    for who in ("ann", "bob"):
        own = [r for r in parts if r.perspective == who]
        assert [r.part for r in own] == [0, 1, 2] and "".join(r.rendered for r in own) == whole[who].rendered
        assert [m for r in own for m in r.masks] == whole[who].masks
    assert chat.render_perspectives(table.limit(0)).count() == 0


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_finds_what_differs_and_looks_at_those_branches_only(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(3000)] + [(None, "u", None), (None, None, "h"), (-4, "n", "n"), (7, "http://h/7", "<p>7</p>")]
    broken = [(i, u, h + "!" if i in (17, 2999) else h) for i, u, h in rows if i != 1500]
    one, two = (warc.archives(pages(spark, x), lost=2) for x in (rows, broken))
    a, b = warc.trees(one), warc.trees(two)
    faults, unequal = warc.audit(a, b)
    got = {(r.archive, r.place, r.fault) for r in faults.collect()}
    assert got == {(0, 17, "corrupt"), (4, 2999 - 2048, "corrupt"), (2, 1500 - 1024, "missing")}
    assert unequal[0] == 1 and max(unequal[:-1]) < 100
    none, equal = warc.audit(a, warc.trees(warc.archives(pages(spark, rows[::-1]), lost=2)))
    assert none.count() == 0 and equal == [0]
    report = warc.report(one, two).collect()
    assert sum(r.fault is None for r in report) + len(got) == len(rows) - 1 and sum(r.copies == 2 for r in report) == 1
    back = {(r.archive, r.place, r.fault) for r in warc.audit(b, a)[0].collect()}
    assert back == {(0, 17, "corrupt"), (4, 2999 - 2048, "corrupt"), (2, 1500 - 1024, "extra")}
    extra = [r for r in warc.report(two, one).collect() if r.fault == "extra"]
    assert [r.page_id for r in extra] == [1500]


def test_one_missing_record_is_one_fault(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 2 else f"<p>{i}</p>") for i in range(300)] + [(5, "http://h/5", "another"), (None, "u", "x"), (None, "u", "y")]
    whole = warc.trees(warc.archives(pages(spark, rows), lost=1))
    for gone in (0, 150, 299, 300, 301):
        part = warc.trees(warc.archives(pages(spark, rows[:gone] + rows[gone + 1 :]), lost=1))
        assert [r.fault for r in warc.audit(whole, part)[0].collect()] == ["missing"]


def test_stored_bytes_are_audited(spark, tmp_path):
    table = pages(spark, [(i, "http://é/", "ü" * i) for i in range(1500)]).withColumns({c: F.lit("x") for c in ("record", "digest", "archive", "index", "content", "place", "node", "id", "start", "length", "copies")})
    one = warc.write_archives(warc.archives(table), str(tmp_path / "a"))
    two = warc.write_archives(warc.damaged(one, every=500), str(tmp_path / "b"))
    at = {}
    for e in one.orderBy("archive", "place").collect():
        text = bytes(e.content).decode()
        assert text.startswith("WARC/1.1\r\nWARC-Type: resource\r\n") and "\r\nWARC-Date: 1970" in text and f"<urn:page:{e.id}>" in text and text.endswith("ü" * e.id + "\r\n\r\n") and e.place == e.id % 1024
        assert e.start == at.get(e.archive, 0) and e.length == len(e.content)
        at[e.archive] = e.start + e.length
    faults = {(r.page_id, r.fault) for r in warc.report(one, two).collect() if r.fault}
    assert faults == {(i, "corrupt") for i in (5, 505, 1005)}
    assert warc.drill(table.limit(0)).count() == 0


def test_trees_against_plain_hashes(spark):
    import hashlib

    rows = [(i, f"http://h/{i}", "x" * (i % 7)) for i in range(600)]
    got = {r.archive: r for r in warc.trees(warc.archives(pages(spark, rows))).collect()}[0]
    level = [f"{e.start}:{e.end}:{e.digest}" for e in got.levels[0]]
    for above in got.levels[1:]:
        folded = [level[i : i + 16] for i in range(0, len(level), 16)]
        want = [f"{c[0].split(':')[0]}:{c[-1].split(':')[1]}:{hashlib.sha256('|'.join(c).encode()).hexdigest()}" for c in folded]
        level = [f"{e.start}:{e.end}:{e.digest}" for e in above]
        assert level == want
    assert len(level) == 1


# mixing


def test_weights_meet_the_limit_and_the_budget(spark):
    rows = [(i, "w " * (5 + i % 3), "en", "big" if i % 10 else ("mid" if i % 20 else "small")) for i in range(2000)]
    docs = H.frame(spark, rows)
    table = mixing.weights(mixing.units(docs, "doc_id", "text", "source"), value=2.0).collect()
    passes = {r.source: r.passes for r in table}
    assert max(passes.values()) == pytest.approx(2.0, abs=0.02) and min(passes.values()) == pytest.approx(1.0, abs=0.01) and sum(r.weight for r in table) == pytest.approx(1)
    plan = mixing.plan(docs, block_tokens=1000).collect()
    used = defaultdict(int)
    for r in plan:
        used[r.source] += r.tokens
    for r in table:
        assert r.tokens_budget - 8 <= used[r.source] <= r.tokens_budget
    assert {r.id for r in plan} == set(range(2000))
    blocks = defaultdict(lambda: defaultdict(int))
    for r in plan:
        blocks[r.block][r.source] += r.tokens
    weight = {r.source: r.weight for r in table}
    for own in list(blocks.values())[:-1]:
        assert own["big"] / sum(own.values()) == pytest.approx(weight["big"], abs=0.05)
    for b in blocks:
        assert sorted(r.position for r in plan if r.block == b) == list(range(sum(r.block == b for r in plan)))


def test_entropy_target_and_fixed_budget(spark):
    rows = [(i, "w w w", "en", f"s{min(i // 100, 4)}") for i in range(1000)]
    units = mixing.units(H.frame(spark, rows), "doc_id", "text", "source")
    table = mixing.weights(units, target="entropy", value=0.98, budget=600).collect()
    entropy = -sum(r.weight * math.log(r.weight) for r in table)
    assert entropy == pytest.approx(0.98 * math.log(5), abs=1e-3) and sum(r.tokens_budget for r in table) == pytest.approx(600, abs=3)


def test_mixing_odd_rows(spark):
    docs = H.frame(spark, H.ODD)
    out = mixing.mixed(docs, value=2.0)
    assert out.columns == docs.columns
    key = lambda r: (r.doc_id, r.text, r.source)
    assert {key(r) for r in out.collect()} == {key(r) for r in docs.collect()}
    assert sum(r.doc_id == 8 for r in out.collect()) >= 2
    assert mixing.mixed(docs.limit(0)).count() == 0


CLASHES = ("_key", "_first", "_block", "_position", "_use", "_uses", "_copy", "key", "row", "id", "n", "use", "uses", "block", "position", "rid", "component_key", "row_key", "at", "kept", "component_id", "token")


def clashing(spark, rows):
    """Documents with a column for every name that operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *(f"{c}{i}" for c in CLASHES)) for i, r in enumerate(rows)], H.SCHEMA + "".join(f", `{c}` string" for c in CLASHES))


def test_rows_come_back_unchanged_whatever_their_columns_are_called(spark):
    docs = clashing(spark, H.ODD)
    own = {tuple(r) for r in docs.collect()}
    for out in (mixing.mixed(docs, value=2.0), minhash.keep_one(docs), quality.keep_good(docs), secrets.redact_secrets(docs.where("doc_id < 12"))):
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= own


def brute_plan(rows, limit, block_tokens):
    """What mixing must use: (source -> tokens granted, whole passes), by plain search for the exponent."""
    total = defaultdict(int)
    for _, text, _, source in rows:
        total[source or ""] += len(H.words(text))
    whole = sum(total.values())
    share = {s: t / whole for s, t in total.items() if t}

    def repeats(a):
        power = {s: p**a for s, p in share.items()}
        budget = max(total[s] / (power[s] / sum(power.values())) for s in share)
        return max(power[s] / sum(power.values()) * budget / total[s] for s in share), {s: power[s] / sum(power.values()) * budget for s in share}

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if repeats(mid)[0] <= limit else (mid, hi)
    return repeats(hi)[1], total


@pytest.mark.parametrize("limit", [1.0, 1.7, 3.0])
def test_plan_against_plain_search(spark, limit):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(1, 30)), "en", str(rng.choice(["a", "b", "c", "d"], p=[0.6, 0.25, 0.1, 0.05]))) for i in range(1500)]
    granted, total = brute_plan(rows, limit, 2000)
    plan = mixing.plan(H.frame(spark, rows), value=limit, block_tokens=2000).collect()
    used, passes = defaultdict(int), defaultdict(lambda: defaultdict(list))
    for r in plan:
        used[r.source] += r.tokens
        passes[r.source][r["pass"]].append(r.id)
    of = defaultdict(set)
    for i, _, _, s in rows:
        of[s].add(i)
    for s, t in granted.items():
        assert t * (1 - 1e-4) - 31 <= used[s] <= t * (1 + 1e-4) + 1
        full = int(t * (1 + 1e-5) // total[s])
        for p, ids in passes[s].items():  # a pass uses each row once; only the last may be a part
            assert len(ids) == len(set(ids)) and set(ids) <= of[s] and (p >= full or set(ids) == of[s])
    blocks = sorted({r.block for r in plan})
    assert blocks == list(range(len(blocks))) and abs(len(blocks) - sum(granted.values()) / 2000) <= 1
    for b in blocks:
        assert sorted(r.position for r in plan if r.block == b) == list(range(sum(r.block == b for r in plan)))


# licences


def test_licenses_and_inheritance(spark):
    rows = [
        (1, "LICENSE text.\nReleased under the MIT License.", "/a/LICENSE"), (2, "no words", "/a/b/c.txt"), (3, "Code. Licensed under the Apache License, Version 2.0. " + "More words. " * 30, "/a/b/d.txt"), (4, None, "/z/y.txt"), (5, "x", None),
        (6, "This work is licensed under the GNU General Public License, version 3.", "/a/q/COPYING"), (7, "y", "/a/q/r/s/t.txt"), (8, "The licence of a driver is not this.", "/z/k.txt"), (8, "The licence of a driver is not this.", "/z/k.txt"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, path string, `row` int")
    got = [(r.doc_id, r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]
    assert got == [(1, "MIT", "MIT", None), (2, None, "MIT", "/a"), (3, "Apache-2.0", "Apache-2.0", None), (4, None, None, None), (5, None, None, None), (6, "GPL-3.0", "GPL-3.0", None), (7, None, "GPL-3.0", "/a/q"), (8, None, None, None), (8, None, None, None)]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


# near duplicates


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in (100, 101, 102))


def test_links_that_bypass_the_hub_are_found(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in rng.choice(200, 22, replace=False):  # too far from the base and from most others
            words[j] = f"e{i // 2}x{j}"  # pairs share their edits
        rows.append((i, " ".join(words)))
    rows.append((99, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    H.same(minhash.near_duplicates(docs, k=1).collect(), H.near(rows, 1))
    H.same(minhash.near_duplicates(docs, k=2).collect(), H.near(rows, 2))


def family(n, shared=1, words=200):
    """A hub and n rows that share a changed word and are each just too far from the hub; their other changes are their own."""
    base = [f"b{i}" for i in range(words)]
    rows, rng = [(0, " ".join(base))], np.random.default_rng(n)
    for i in range(n):
        w = list(base)
        places = rng.choice(words - shared, 23 - shared, replace=False) + shared
        for j in places:
            w[j] = f"e{i}x{j}"
        for j in range(shared):
            w[j] = f"same{j}"
        rows.append((i + 1, " ".join(w)))
    return rows


def test_a_changed_word_in_common_forms_no_pairs(spark, monkeypatch):
    formed = []
    real = minhash._linked

    def counted(pairs, full, threshold):
        formed.append(pairs.count())
        return real(pairs, full, threshold)

    monkeypatch.setattr(minhash, "_linked", counted)
    sizes = {}
    for n in (100, 400):
        rows = family(n)
        formed.clear()
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()
        H.same(got, H.near(rows, 1))
        sizes[n] = formed[2]
    assert sizes[400] <= 8 * max(sizes[100], 100), sizes  # linear, not sixteenfold
    assert sizes[400] < 400 * 399 / 2 / 20


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    x = np.sort(rng.integers(0, 2**63, 2000).astype(np.uint64))
    a, b = x[:1000], x[200:1200]
    sig = minhash.signatures(np.concatenate((a, b)), np.array([1000, 1000]))
    assert (sig[0] == sig[1]).mean() == pytest.approx(800 / 1200, abs=0.08)
    small = minhash.signatures(x[[0, 900, 1900]], np.array([3]))
    assert set(small[0].tolist()) == set(x[[0, 900, 1900]].tolist())


def test_tokens_are_made_only_of_what_a_class_can_share(spark, monkeypatch):
    rng, base = np.random.default_rng(5), [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 101):
        left_out = set(rng.choice(200, rng.integers(5, 60), replace=False).tolist())
        rows.append((i, " ".join(w for j, w in enumerate(base) if j not in left_out)))
    made, real = [], minhash.join_salted

    def counted(left, right, on, salt, n, how="inner"):
        out = real(left, right, on, salt, n, how)
        if on == ["hub", "class"]:
            made.extend(math.comb(r["extra"] + r["n"], r["n"]) for r in out.select("extra", "n").collect())
        return out

    monkeypatch.setattr(minhash, "join_salted", counted)
    H.same(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect(), H.near(rows, 1))
    assert sum(made) <= 300 * len(rows), sum(made)
