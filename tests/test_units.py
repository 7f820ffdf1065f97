import random

from spanrank.operators import code, units

# Texts, ranges and expected results below are fixed values: behaviour that must match.

DOC = "---\nstatus: live\nverified:\n  by: human:me\ntags: [a]\n---\n\npreamble\n\n## Top\n\ntext\n```\n# not a heading\n```\n### Nested\nend\n"


def sections(spark, text):
    return units.sections(spark.createDataFrame([("a.md", text)], "path string, text string")).orderBy("start").collect()


def test_sections(spark):
    got = sections(spark, DOC)
    assert [r.heading for r in got] == [None, "Top", "Nested"]
    assert got[0].start == 7 and all(a.end + 1 == b.start for a, b in zip(got, got[1:]))
    assert got[2].breadcrumb == ["Top"] and got[1].breadcrumb == []


def test_plain_cases(spark):
    one = sections(spark, "# Only\n\nbody\n")
    assert [(r.start, r.end, r.heading) for r in one] == [(1, 3, "Only")]
    assert sections(spark, "") == [] and sections(spark, "\n \n") == []
    assert [r.heading for r in sections(spark, "#no\n####### no\n#\tno\n# yes\r\nx")] == [None, "yes"]
    assert sections(spark, None) == []


def test_budget():
    lines = ("## H\n\n" + "\n\n".join(["x" * 40] * 3)).split("\n")
    got = units.pieces(lines, 60)
    assert len(got) > 1 and all(len(t) <= 60 and not cut for _, _, t, cut in got)
    assert got[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:])) and got[-1][1] == len(lines) - 1
    assert units.pieces(["y" * 200], 50) == [(0, 0, "y" * 50, True)]


def test_functions(spark):
    rust = "use x;\n\n/// Adds.\n#[inline]\npub fn add(a: i32) -> i32 {\n    a\n}\n\nfn two() {\n    2;\n}\n"
    assert [x[:3] for x in code.cut("rust", rust)] == [(3, 7, "add"), (9, 11, "two")]
    assert [x[:3] for x in code.cut("python", "# far\n\n# near\ndef f():\n    return 1\n")] == [(3, 5, "f")]
    assert [x[:3] for x in code.cut("c", "#include <x.h>\nint main(void) {\n  return 0;\n}\n")] == [(2, 4, "main")]
    assert code.cut("python", "def (") == []
    files = spark.createDataFrame([("a/x.py", "def f():\n  pass"), ("y.txt", "def g(): 1"), ("z.go", None)], "path string, text string")
    assert [(r.path, r.heading) for r in code.functions(files).collect()] == [("a/x.py", "f")]


def test_batches(spark):
    files = spark.createDataFrame([("a", 300), ("b", 300), ("c", 900), ("d", 1)], "path string, n int")
    assert [r.batch for r in units.commit_batches(files).orderBy("path").collect()] == [0, 0, 1, 2]


def test_batches_over_many_partitions(spark):
    r = random.Random(3)
    sizes = [r.choice([0, 1, 5, 30, 70, 200]) for _ in range(400)]
    rows = spark.createDataFrame([(f"{i:04}", n) for i, n in enumerate(sizes)], "path string, n int").repartition(7)
    want, held, number = [], 0, 0
    for n in sizes:
        want.append(number)
        held += n
        if held >= 100:
            number, held = number + 1, 0
    assert [x.batch for x in units.commit_batches(rows, 100).orderBy("path").collect()] == want
    want, held, number = [], 0, 0
    for n in sizes:
        if held and held + n > 100:
            number, held = number + 1, 0
        held += n
        want.append(number)
    assert [x.batch for x in units.char_batches(rows, "path", "n", 100).orderBy("path").collect()] == want


def test_functions_of_other_languages():
    names = lambda lang, text: [x[:3] for x in code.cut(lang, text)]
    assert names("cpp", "class A {\npublic:\n  A(int x) : b(x) { }\n  // note\n  int get() const { return b; }\n};\nint A::size(int q) {\n if (q) { return 1; }\n}\n") == [(3, 3, "A"), (4, 5, "get"), (7, 9, "A::size")]
    assert names("java", 'class A {\n  @Override\n  public String toString() {\n    return "{";\n  }\n}\n') == [(2, 5, "toString")]
    assert names("javascript", "const x = 1\nexport async function f(a) {\n  return a\n}\nclass B {\n  go(x) { if (x) { y() } }\n}\n") == [(2, 4, "f"), (6, 6, "go")]
    assert names("go", "func (s *S) Run(x int) error {\n\treturn nil\n}\n// c\nfunc main() {\n}\n") == [(1, 3, "Run"), (4, 6, "main")]
    assert names("bash", '# doc\nrun() {\n  echo "}"\n}\nfunction two {\n  ls\n}\n') == [(1, 4, "run"), (5, 7, "two")]
    assert names("rust", "fn open() { '{'; \"}\"; fn inner<'a>(x: &'a str) {}\n") == [(1, 1, "inner")]  # one that never closes is left out


def test_chunks_of_a_long_function():
    rust = "fn f() {\n" + "".join(f"    let a{i} = {i};\n" for i in range(10)) + "}"
    got = code.chunks("rust", rust, 90)
    assert all(len(t) <= 90 and t.startswith("fn f() {\n") for _, _, t in got) and len(got) > 1
    assert got[0][0] == 1 and got[-1][1] == 11 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:]))
    assert code.chunks("rust", "fn f() { }", 90) == [(0, 0, "fn f() { }")]


def test_longest_section(spark):
    none = units.longest(sections_frame(spark, ""), 100).first()
    assert (none.longest, none.origin, len(none.text)) == (0, "prose", 100)
    some = units.longest(sections_frame(spark, "# A\nx\n# B\nlonger\n"), 5).first()
    assert (some.longest, some.text, some.origin) == (10, "# B\nl", "section")


def sections_frame(spark, text):
    return units.sections(spark.createDataFrame([("a.md", text)], "path string, text string"))
