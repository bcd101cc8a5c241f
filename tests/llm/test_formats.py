"""Fill-in-middle, the filter audit and chat formatting against plain versions."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from frames import AWKWARD, DOCS, clashing, docs
from pyspark.sql import functions as F

from pelagos.llm.chat_format import ChatTemplate, as_replies, best_paths, format_chats, read_back
from pelagos.llm.fill_middle import Checkpoints, Sentinels, fill_in_middle, restored
from pelagos.llm.filter_audit import filter_audit, word_counts

LINES = ["one\ntwo\nthree\n", "é😀\n\n\nlast", "holds <S> itself\nand more", "\n", "a <P", "line\n" * 5000 + "é" * 70_000 + "\nend"]
UNITS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "char": re.compile(r"(?s).")}


@pytest.mark.parametrize("unit", ["line", "char"])
def test_checkpoints_find_every_border(unit):
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choices("ab\né😀", k=rng.randrange(60)))
        units = UNITS[unit].findall(text)
        index = Checkpoints(text.encode(), unit, rng.randrange(1, 7), rng.randrange(1, 20))
        assert index.n == len(units)
        assert len(index.units) <= len(units) + 1
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.locate(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fill_in_middle(spark, unit):
    texts = [*AWKWARD, *LINES]
    for percent, spm in ((100, 50), (60, 0), (0, 100)):
        made = fill_in_middle(clashing(docs(spark, texts)), unit=unit, fim_percent=percent, spm_percent=spm, every=3)
        rows = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == len(texts)
        for r in rows:
            text = texts[r.id] or ""
            units = UNITS[unit].findall(text)
            h = hashlib.sha256(f"7:{r.id}".encode()).hexdigest()
            h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
            a, b = sorted(x % (len(units) + 1) for x in h[:2])
            pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            plain = not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent
            form = "plain" if plain else "spm" if h[3] % 100 < spm else "psm"
            want = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
            assert (r.n, r.form, r.output, r.back) == (len(units), form, want, text)
            assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (len(pre), len(mid)))


def test_fill_in_middle_of_null_ids_repeated_rows_and_no_rows(spark):
    rows = fill_in_middle(docs(spark, ["a\nb\n", "a\nb\n", "a\nb\n"], [None, 4, 4])).collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows if r.id == 4}) == 1
    assert fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="sentinel"):
        Sentinels("aba", "<S>", "<M>")


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    least, masks = {}, {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "D": bool(re.search("[#$%&*|]", text))}
        fails["C"] = 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)
        fails["E"] = i is not None and i > least[text]
        masks.setdefault(part or "", []).append(({f for f, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, docs_ in masks.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                left = [d for d in docs_ if not d[0] & set(order[:k])]
                gone = [d for d in left if f in d[0]]
                shapley[f] += len(gone)
                redundant = sum(f in d[0] and bool(d[0] & set(order[:k])) for d in docs_)
                out[part, order, k + 1] = [len(left) - len(gone), len(gone), redundant, sum(d[0] == {f} for d in docs_), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_audit(spark):
    rng = random.Random(4)
    texts = [*AWKWARD, "word " * 300, "HELLO World $5", " ".join(f"w{i}" for i in range(250))]
    texts += [" ".join(rng.choices(["a", "B", "c#", "dd", "　"], k=rng.randrange(400))) for _ in range(20)]
    rows = [(i, t, rng.choice(["en", "fr", "", None])) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(texts[10:20]), "en") for i in range(15)]  # copies
    rows += [(None, texts[11], "fr"), (None, None, None), rows[11], rows[11], (11, "another text of this id", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, mask string, word string")
    found = filter_audit(frame.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found.collect()}
    assert got == plain_audit(rows, labels)


def test_filter_audit_of_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(spark.createDataFrame([], DOCS), labels).count() == 0
    assert filter_audit(docs(spark, ["a", None]), labels).count() == 600


def test_word_counts_count_repeated_rows_once(spark):
    rows = word_counts(docs(spark, ["a b a", "a b a", "a b a", "", None], [1, 1, 1, 2, 2])).collect()
    assert sorted((r.id, r.n_words, r.n_distinct) for r in rows) == [(1, 3, 2), (2, 0, 0)]


TREE = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def plain_paths(rows, branches):
    """(tree, leaf, nodes from the root) of the best branches."""
    known = {(t, n): (p, s or 0.0) for t, n, p, _, _, s in rows}
    parents = {(t, p) for (t, _), (p, _) in known.items()}
    found = {}
    for t, n in known:
        if (t, n) in parents:
            continue
        path, at = [], n
        while (t, at) in known:
            path.append(at)
            at = known[t, at][0]
        found.setdefault(t, []).append((-sum(known[t, x][1] for x in path), -len(path), n, path[::-1]))
    return sorted((t, p[2], p[3]) for t, all_ in found.items() for p in sorted(all_)[:branches])


@pytest.mark.parametrize("branches", [1, 2, None])
def test_reply_trees(spark, branches):
    rng = random.Random(7)
    rows = []
    for t in range(12):
        size = rng.choice([1, 2, 9, 40])
        deep = rng.random() < 0.5
        for n in range(size):
            parent = None if not n else n - 1 if deep and rng.random() < 0.9 else rng.randrange(n)
            rows.append((t, n, parent if rng.random() < 0.95 else 999, "user" if n % 2 == 0 else "assistant", f"t{t}n{n}", rng.choice([None, 0.5, 1.0, -1.0])))
    found = best_paths(spark.createDataFrame(rows, TREE).selectExpr("tree_id tree", "node_id node", "parent_id parent", "coalesce(score, 0D) score"), branches)
    got = {}
    for r in found.collect():
        got.setdefault((r.tree, r.leaf), {})[r.pos] = r.node
    assert sorted((*k, [v[i] for i in sorted(v)]) for k, v in got.items()) == plain_paths(rows, branches)
    messages = clashing(spark.createDataFrame(rows, TREE).withColumnRenamed("score", "points"))
    chats = format_chats(messages.withColumn("tree", F.lit("x")), score_col="points", branches=branches).collect()
    told = {(r.tree, r.leaf): [x for _, x in ChatTemplate().turns(r.formatted)] for r in chats}
    assert told == {(t, leaf): [f"t{t}n{n}" for n in path] for t, leaf, path in plain_paths(rows, branches)}


def test_circles_nulls_and_repeated_messages(spark):
    rows = [(1, 5, 6, "user", "a", None), (1, 6, 7, "assistant", "b", None), (1, 7, 5, "user", "c", None), (1, 2, 6, "assistant", "d", None)]
    rows += [(2, 1, 1, "user", "own parent", None), (None, 1, None, None, None, None), (None, 1, None, None, None, None), (3, None, None, "user", "x", 1.0)]
    chats = format_chats(spark.createDataFrame(rows, TREE), score_col="score", branches=None).collect()
    told = sorted((r.tree or 0, [x for _, x in ChatTemplate().turns(r.formatted)]) for r in chats)
    # the circle 5-6-7 is cut at its smallest node 5: 7 replies to 5, 6 to 7, and 2 to 6
    assert told == [(0, [""]), (1, ["a", "c", "b", "d"]), (2, ["own parent"]), (3, ["x"])]
    assert format_chats(spark.createDataFrame([], TREE)).count() == 0


def test_escapes_are_reversible(spark):
    template = ChatTemplate()
    rng = random.Random(2)
    bits = ["\\", "<", "|", ">", "<|im_end|>", "<|im_sep|>", "</s>", "[INST]", "<<SYS>>", "im_end|>", "a", "\n", "é", "😀", "$1"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(8))) for _ in range(400)] + [None]
    rows = [(i // 3, i % 3, rng.choice(["user", "assistant", "<|im_sep|>\\", None]), t) for i, t in enumerate(texts)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = format_chats(as_replies(talks))
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    out = {r.tree: r for r in chats.collect()}
    for c, turns in want.items():
        assert template.turns(out[c].formatted) == turns
        inner = out[c].formatted.replace(template.open, "").replace(template.mid, "").replace(template.close, "")
        assert not any(k in inner for k in ("</s>", "[INST]", "<<SYS>>", "<|im_"))
    for r in read_back(chats).collect():
        loss = "".join(t for role, t in want[r.tree] if role == "assistant")
        assert r.n_turns == len(want[r.tree])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.tree]).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(out[r.tree].formatted)


def test_long_conversation_and_other_template(spark):
    template = ChatTemplate(open="[INST]", mid="[SEP]", close="[/INST]", controls=("</s>",), escape="$")
    rows = [(1, i, "user" if i % 2 else "assistant", f"$ [INST] {i} [SEP] </s>" * 9) for i in range(300)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = format_chats(as_replies(talks), template=template)
    assert template.turns(chats.first().formatted) == [(r[2], r[3]) for r in rows]
    assert read_back(chats, template).first().loss_chars == sum(len(r[3]) for r in rows if r[2] == "assistant")


def test_templates_that_cannot_be_taken_apart_are_refused():
    for marks in (dict(close="aba"), dict(controls=("x",)), dict(controls=("a\\b",)), dict(escape="ab")):
        with pytest.raises(ValueError, match="escape|mark"):
            ChatTemplate(**marks)
