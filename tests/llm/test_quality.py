import random
import re

from helpers import frame, odd_rows, sentence

from docloom.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)}
    said = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(said) - len(set(said)), len(covered)


def test_base_measures_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [r for r in odd_rows() if not (r[1] or "").startswith("lorem")]
    for k in range(60):
        lines = [sentence(rng, rng.randint(0, 9)) + rng.choice((".", "", " | x | y", " ###", "\t")) for _ in range(rng.randint(1, 8))]
        rows.append((100 + k, "\n".join(lines + rng.choices(lines, k=rng.randint(0, 3)))))
    rows.append((900, "é ü 𝒳 " * 20))
    got = quality.assess(frame(spark, rows)).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(brute(t) for _, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_lines_first(spark):
    clean = "\n".join(f"{sentence(random.Random(k), 14).capitalize()}." for k in range(8))
    junk = "\n".join("home | about | contact | help | terms" + str(k) for k in range(30))
    rows = [(1, clean), (2, clean + "\nHome | News | About"), (3, junk + "\n" + clean), (4, clean.upper())]
    got = {r.doc_id: r for r in quality.assess(frame(spark, rows, extra=False)).collect()}
    assert got[1].kept and got[1].cleaned == clean and got[1].lost_chars == 0
    assert got[2].kept and got[2].cleaned == clean
    assert not got[3].kept and got[3].cleaned == clean
    assert not got[4].kept


def test_long_text_and_empty_table(spark):
    got = quality.assess(frame(spark, [(8, "lorem ipsum dolor " * 4000)], extra=False)).first()
    assert got.n_repeat_words == got.n_words == 12000 and not got.kept
    assert quality.assess(frame(spark, [])).count() == 0
