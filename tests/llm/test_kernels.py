import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import lm_score, packing, pii


def _model():
    rng = np.random.default_rng(0)
    tables = lm_score.Tables(rng.integers(0, 500, lm_score.IDS).astype(float), rng.random(lm_score.IDS) < 0.5)
    w = {n: a.astype(np.float64) for n, a in lm_score.start_weights(tables).items()}
    x, y = (rng.integers(0, lm_score.IDS - 2, (3, n)).astype(np.uint16) for n in (lm_score.WIDE, lm_score.STEP))
    x[0, :3], y[1, -9:] = lm_score.PAD, lm_score.PAD
    return w, tables, x, y


def test_gradient_matches_differences():
    w, tables, x, y = _model()
    got = lm_score.gradient(w, tables, x, y)

    def loss():
        return -lm_score.log10_scores(w, tables, x, y).sum() * np.log(10) / (y != lm_score.PAD).sum()

    for n in lm_score.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(got[n])), got[n].shape)
        was, ends = w[n][at], []
        for step in (1e-3, -1e-3):
            w[n][at] = was + step
            ends.append(loss())
        w[n][at] = was
        assert abs(got[n][at] - (ends[0] - ends[1]) / 2e-3) < 0.03 * abs(got[n][at]) + 1e-7


def test_scores_match_a_plain_loop():
    w, t, x, y = _model()
    want = np.zeros(len(x))
    softmax = lambda a: np.exp(a - a.max()) / np.exp(a - a.max()).sum()
    for n in range(len(x)):
        e = [w["e"][:, t.row[i]] for i in x[n]]
        for s in range(lm_score.STEP):
            if y[n, s] == lm_score.PAD:
                continue
            at = s + lm_score.CONTEXT - 1
            seen = [r for r in range(lm_score.CONTEXT) if r == 0 or x[n, at - r] != lm_score.PAD]
            p = softmax(np.array([(w["q"] @ e[at]) @ (w["k"] @ e[at - r]) + w["pos"][r] for r in seen]))
            h = np.append(np.maximum(w["own"] @ e[at] + sum(a * (w["v"] @ e[at - r]) for a, r in zip(p, seen, strict=True)) + w["b1"], 0), 1)
            c = t.classes[y[n, s]]
            want[n] += np.log10(softmax(w["out"] @ h)[c] * softmax(w["in"][c] @ h)[t.place[y[n, s]]]) + t.share[y[n, s]] / np.log(10)
    assert np.allclose(lm_score.log10_scores(w, t, x, y), want, rtol=1e-5)


def test_scores_of_large_logits_are_finite():
    w, t, x, y = _model()
    w = {n: (a * (300 if n in ("out", "q") else 1)).astype(np.float32) for n, a in w.items()}
    assert np.isfinite(lm_score.log10_scores(w, t, x, y)).all()


def test_shares_within_a_place_sum_to_one():
    _, t, _, _ = _model()
    cells = np.bincount(t.classes.astype(int) * lm_score.PLACES + t.place, np.exp(t.share.astype(float)), lm_score.CLASSES * lm_score.PLACES)
    assert np.allclose(cells[cells > 0], 1, atol=1e-4)


def test_windows_score_each_id_once():
    for n in (0, 1, 39, 63, 64, 65, 200):
        ids = np.arange(1, n + 1, dtype="<u2")
        x, y = lm_score.halves(lm_score.windows(ids.tobytes()))
        assert [i for i in y.ravel() if i != lm_score.PAD] == [*ids, lm_score.END]
        assert x[0, lm_score.CONTEXT - 1] == lm_score.END
        # what stands before a target is the target before it
        assert (x[:, lm_score.CONTEXT :] == y[:, :-1]).all()
        assert all((x[k, : lm_score.CONTEXT] == y[k - 1, -lm_score.CONTEXT :]).all() for k in range(1, len(x)))


@given(st.text("a@.1-+%2 3(", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_match_plain_patterns(text):
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii._luhn(digits):
            want.append(("card", *m.span()))
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    assert pii.base_spans(text) == want


def test_steps_use_their_arrays_again():
    w, t, x, y = _model()
    room = lm_score.Room()
    want, first = lm_score.gradient(w, t, x, y), lm_score.gradient(w, t, x, y, room)
    kept = {n: id(a) for n, a in room.kept.items()}
    part, again = lm_score.gradient(w, t, x[:2], y[:2], room), lm_score.gradient(w, t, x, y, room)
    assert kept and {n: id(a) for n, a in room.kept.items()} == kept
    assert all(np.array_equal(want[n], g[n]) for n in want for g in (first, again))
    assert all(np.allclose(part[n], lm_score.gradient(w, t, x[:2], y[:2])[n]) for n in part)


def test_letters_are_encoded_once_whatever_stands_behind():
    words, asked = packing.WordEncoder(packing.tokenizer_path()), []

    class Asked:
        def __init__(self, real):
            self.encode_batch, self.encode_batch_fast = (lambda texts, f=f, **how: asked.extend(texts) or f(texts, **how) for f in (real.encode_batch, real.encode_batch_fast))

    words.tokenizer, words.letters = Asked(words.tokenizer), Asked(words.letters)
    list(words.encode(["thersted, thersted. thersted thersted&&& gr\u00fcn. gr\u00fcn,", "thersted!? gr\u00fcn"]))
    assert sum(t.count("thersted") for t in asked) == 1 and sum(t.count("gr") for t in asked) == 1


@given(st.lists(st.text("abXZ'|!,.<>-#09 \n\u00df\u00e0\u00c4\u00f7\u00b5\u00aa\u0301\u4e2d\u0130\u03a3", max_size=20), max_size=5))
@settings(max_examples=200, deadline=None)
def test_words_put_together_match_whole_texts(texts):
    words = packing.encoder(packing.tokenizer_path())
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in words.encode(texts)] == want


def test_texts_taken_together_give_their_words_and_ids():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    odd = ["", None, " a  b ", "É<|endoftext|> x", "<|", " \t\n\x0b\x0c\r ", "x\x1cy\x0bz \x85 ab", "foo|bar don't DON'T, naïve!! ÿ× ÷ ß.", "a\u3000b İI ŉ ﬁ", "Ab ab AB, ab, ab!?"]
    for texts in (pa.array(odd), pa.array(["left out", *odd]).slice(1), pa.array(odd[:2]), pa.array([None], pa.string())):
        kinds, at, sizes, ids, n_ids = encoder.together(texts)
        words = [kinds[k].as_py() for k in at.tolist()]
        stops, id_stops = sizes.cumsum().tolist(), n_ids.cumsum().tolist()
        assert len(words) == sum(sizes) and len(ids) == sum(n_ids) and len({*kinds.to_pylist()}) == len(kinds)
        for k, text in enumerate(texts.to_pylist()):
            assert [w.encode() for w in words[stops[k] - sizes[k] : stops[k]]] == (text or "").encode().lower().split()
            assert ids[id_stops[k] - n_ids[k] : id_stops[k]].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_counts_are_given_out_in_parts_that_add_up():
    rng, counts, want, got, parts = np.random.default_rng(1), lm_score.Counts(50), Counter(), Counter(), 0
    for size in (0, 30, 30, 60, 5, 90, 40):
        words, n = [f"w{k}" for k in rng.choice(120, size, replace=False)], rng.integers(0, 3, size)
        want.update({w: int(k) for w, k in zip(words, n, strict=True) if k})
        out = counts.add(pa.array(words, pa.string()), n)
        parts += out.num_rows > 0
        for part in (out, counts.rest() if size == 40 else out.slice(0, 0)):
            assert len({*part["word"].to_pylist()}) == part.num_rows
            for w, k in zip(part["word"].to_pylist(), part["n"].to_pylist(), strict=True):
                got[w] += k
        assert counts.rows < 100
    assert parts and got == want and counts.rest().num_rows == 0


def test_words_whose_ids_do_not_tell_their_ends_are_still_parted():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    words = [b"naive", b"stra\xc3\x9fe", b"antidisestablishmentarianism", b"a"]
    want = encoder._letters(words)
    encoder.final = np.zeros_like(encoder.final)
    assert encoder._letters(words) == want == encoder._raw([w.decode() for w in words])
