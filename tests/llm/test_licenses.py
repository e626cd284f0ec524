from billspark.llm.licenses import TEMPLATES, find_licenses
from tests.llm.cases import LONG, awkward_documents, no_documents


def test_templates_are_found_anywhere(spark):
    notices = [text for _, text in TEMPLATES]
    texts = [f"{LONG[:700]}\n{n}.\n{LONG[:900]}" for n in notices] + [n.upper() for n in notices]
    near = "Redistribution and use in source or binary forms, with or without modification, are permitted"
    rows, docs = awkward_documents(spark, [*texts, near, "under the License", " and ".join(notices)])
    got = {r.doc_id: r for r in find_licenses(docs).collect()}
    for i, (name, _) in enumerate(TEMPLATES + TEMPLATES):
        assert name in got[100 + i].licenses.split(","), name
        assert got[100 + i].containment == 1.0
    last = 100 + 2 * len(TEMPLATES)
    assert got[last].licenses == "" and got[last + 1].licenses == ""  # two of eleven shingles differ by one word each
    assert set(got[last + 2].licenses.split(",")) == {n for n, _ in TEMPLATES}
    assert all(got[i].n_licenses == 0 for i in (1, 2, 3, 4, 5, None))
    assert find_licenses(docs).count() == len(rows)
    assert find_licenses(no_documents(spark)).count() == 0
    assert find_licenses(docs, templates=(("none", "two words"),)).filter("n_licenses > 0").count() == 0


def test_no_python_on_the_main_path(spark):
    _, docs = awkward_documents(spark)
    plan = find_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_templates_of_any_length(spark):
    import random

    rng = random.Random(3)
    made = {n: " ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (1, 2, 3, 4, 5, 8, 90, 130, 1500)}
    templates = tuple((f"T{n}", text) for n, text in made.items()) + (("blank", " ,;"),)
    texts = list(made.values()) + [f"{LONG[:3000]} {text}\n{LONG[:2000]}" for text in made.values()]
    cut = made[1500].split()
    texts += [" ".join(cut[:1300]), " ".join(cut[:1100])]  # 0.87 and 0.73 of its shingles
    _, docs = awkward_documents(spark, texts)
    got = {r.doc_id: r for r in find_licenses(docs, templates).collect()}
    for i, n in enumerate(made):
        assert f"T{n}" in got[100 + i].licenses.split(","), n
        assert (f"T{n}" in got[109 + i].licenses.split(",")) == (n > 2), n
    assert "T1500" in got[118].licenses.split(",") and "T1500" not in got[119].licenses.split(",")
    assert all(got[i].n_licenses == 0 for i in (1, 2, 3, 4, None))
    assert find_licenses(docs, ()).filter("n_licenses > 0").count() == 0


def test_classes():
    from billspark.llm.licenses import classes_up_to, template_table  # noqa: F401

    assert [classes_up_to(n)[-1] for n in (0, 1, 2, 3, 4, 5, 64, 65)] == [1, 1, 2, 4, 4, 8, 64, 128]
