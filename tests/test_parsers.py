import pytest

from quern.operators import parsers as P
from quern.operators import policy
from quern.sources import readers as R

FILE = "path string, text string"


def test_lineage_of_tables(rows):
    files = rows(FILE, ("m/1.sql", "CREATE TABLE users (id INT);\nALTER TABLE public.users ADD COLUMN x INT; -- DROP TABLE old"), ("app/models.py", "class U:\n    __tablename__ = 'users'\n"), ("n.py", None))
    refs = P.table_references(files)
    got = [(r.path, r.operation, r.line_no) for r in P.lineage(refs, "users").collect()]
    assert got == [("app/models.py", "MODEL", 2), ("m/1.sql", "CREATE", 1), ("m/1.sql", "ALTER", 2)] or sorted(got) == sorted([("app/models.py", "MODEL", 2), ("m/1.sql", "CREATE", 1), ("m/1.sql", "ALTER", 2)])
    assert refs.where("table = 'old'").count() == 0


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("CREATE TABLE users (id INT);", {"NON_IDEMPOTENT"}), ("CREATE TABLE IF NOT EXISTS users (id INT);", set()),
        ("DROP TABLE users;", {"NON_IDEMPOTENT", "DESTRUCTIVE_UNGUARDED"}), ("-- ALLOW_DESTRUCTIVE\nDROP TABLE IF EXISTS users;", set()), ("SELECT 1; TRUNCATE t", {"DESTRUCTIVE_UNGUARDED"}),
    ],
)
def test_migration_findings(rows, sql, want):
    assert {r.severity for r in P.migration_findings(rows(FILE, ("a.sql", sql))).collect()} == want


PYTHON = """router = APIRouter(prefix="/api/samples")

@router.get("")
async def listed(): ...

@router.post("/auto-sync")
def sync(x): ...

@router.delete("/{sample_id}")
def gone(sample_id): ...
"""
CLIENT = """export function Table() {
  fetch(`/api/samples`)
  fetch("/api/samples/auto-sync", {
    method: "POST",
  })
  api.delete(`/api/samples/${id}`)
}
"""


def test_routes_and_consumers_meet(rows):
    routes = {(r.method, r.canonical, r.handler) for r in P.api_routes(rows(FILE, ("r.py", PYTHON))).collect()}
    assert routes == {("GET", "/api/samples", "listed"), ("POST", "/api/samples/auto-sync", "sync"), ("DELETE", "/api/samples/:id", "gone")}
    calls = {(r.method, r.canonical, r.symbol) for r in P.endpoint_consumers(rows(FILE, ("t.tsx", CLIENT))).collect()}
    assert {c[:2] for c in calls} >= {("POST", "/api/samples/auto-sync"), ("DELETE", "/api/samples/:id")} and all(c[2] == "Table" for c in calls)
    script = P.api_routes(rows(FILE, ("s.js", "router.get('/x', handle)\napp.post('/y')"))).collect()
    assert {(r.method, r.route, r.handler) for r in script} == {("GET", "/x", "handle"), ("POST", "/y", "anonymousHandler")}


def test_symbols_and_dependencies(rows):
    files = rows(FILE, ("lib/a.py", "import util\n\ndef f(x):\n    return x\n\nclass C:\n    def m(self): pass\n"), ("lib/util.py", "x = 1"), ("b.rs", "pub fn g(a: i32) -> i32 {\n  a\n}\nmod util;\n"), ("bad.py", "def broken(:\n    pass\n"))
    got = {(r.path, r.name, r.kind, r.start_line, r.end_line) for r in P.symbols(files).collect()}
    assert {("lib/a.py", "f", "function", 3, 4), ("lib/a.py", "C", "class", 6, 7), ("b.rs", "g", "function", 1, 3), ("bad.py", "broken", "function", 1, 2)} <= got
    edges = {(r.src, r.dst) for r in P.resolved_dependencies(P.dependency_hints(files), files).collect()}
    assert edges == {("lib/a.py", "lib/util.py"), ("b.rs", "lib/util.py")}
    assert {r.path for r in P.diagnostics(files).where("severity = 'error'").collect()} == {"bad.py"}
    assert P.skeletons(files).where("path = 'b.rs'").first().skeleton == "pub fn g(a: i32) -> i32 {"
    assert {r.name for r in P.contracts(files).collect()} >= {"f", "C", "m", "g"}


def test_call_arity():
    cases = {"calc()": 0, "calc(10)": 1, "calc(10, [1, 2, 3])": 2, "calc(10, fn(a, b), 30)": 3, "other(1)": None}
    assert {k: P.call_arity(k, "calc") for k in cases} == cases


def test_patch_breakages(rows):
    body = "async def load(a, b, c=1):\n    pass\nx = load(1)\ny = await load(1, 2)\nz = load(1, 2)\nw = await load(1, 2, 3, 4)\n"
    got = [(r.line_no, r.breakage) for r in P.patch_breakages(rows(FILE, ("p.py", body)), "async def load(a, b, c=1):").collect()]
    assert got == [(3, "too_few_arguments"), (5, "missing_await"), (6, "too_many_arguments")]


def test_runner_output_and_learnings(rows):
    r = P.test_counts(rows("id int, output string", (1, "test result: ok. 3 passed; 1 failed; 2 ignored"), (2, None))).orderBy("id").collect()
    assert (r[0].passed, r[0].failed, r[0].ignored) == (3, 1, 2)
    text = "# Notes\nx\n## Key Learnings:\n- first one\n2. second\n# Next\n- no\n"
    assert [x.learning for x in P.learnings(rows("id int, text string", (1, text), (2, None))).collect()] == ["first one", "second"]


def test_policy_replay(rows):
    n = rows(
        "trajectory_id long, id long, parent_id long, cost_tokens long, latency_ms long, reward_score double, visit_count long, value_estimate double, is_solution boolean, note string",
        (1, 1, None, 10, 5, 0.0, 3, 0.0, False, ""), (1, 2, 1, 9000, 5, -1.0, 1, 0.0, False, "error"), (1, 3, 1, 20, 5, 0.5, 1, 0.9, False, ""), (1, 4, 3, 30, 5, 1.0, 1, 1.0, True, None),
    )
    got = {r.policy: r for r in policy.replay(n).collect()}
    assert len(got) == len(policy.PRESETS) and all(r.solved and r.steps == 3 and r.tokens == 60 for r in got.values())
    assert {r.gain for r in policy.compared(policy.replay(n)).collect()} == {0.0}


def test_tree_search_finds_the_solution(rows):
    n = rows(
        "trajectory_id long, id long, parent_id long, reward_score double, value_estimate double, is_solution boolean, note string",
        (1, 1, None, 0.0, 0.0, False, ""), (1, 2, 1, -1.0, 0.9, False, "error"), (1, 3, 1, 0.2, 0.1, False, ""), (1, 4, 3, 1.0, 0.5, True, None), (1, 5, 1, 0.1, 0.2, False, ""),
    )
    r = policy.search(n).first()
    assert r.solved and r.path == [1, 3, 4] and r.visited == 4


def test_git_sources(spark, tmp_path):
    import subprocess

    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@b", *a], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "."), git("commit", "-qm", "start")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    git("commit", "-qam", "fix: add y")
    (tmp_path / "b.py").write_text("z\n")
    assert {(r.subject, r.is_fix, r.insertions) for r in R.git_history(spark, str(tmp_path)).collect()} == {("start", False, 1), ("fix: add y", True, 1)}
    assert [tuple(r) for r in R.git_diff(spark, str(tmp_path), "HEAD~1").collect()] == [("a.py", 1, 0)]
    blame = R.git_blame(spark, str(tmp_path), "a.py", 2, 2).collect()
    assert [(r.line_no, r.author, r.line) for r in blame] == [(2, "Ann", "y = 2")]
    assert [tuple(r) for r in R.git_status(spark, str(tmp_path)).collect()] == [("??", "b.py")]


def test_repository_roles(rows):
    f = rows("path string", ("web/package.json",), ("web/Dockerfile",), ("core/Cargo.toml",), ("core/src/a.rs",), ("setup.py",))
    assert {tuple(r) for r in R.repository_roles(f).collect()} == {("web", "javascript,service"), ("core", "rust"), ("", "python")}


def test_source_tree_scan(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1\n", "node_modules/b.js": "no", "c.min.js": "no", "docs/d.md": "---\nid: m1\nkind: gotcha\nseverity: high\napplies_to: [src/**, 'a.py']\ntags:\n  - one\n  - two\n---\nBody here\n", "skip/e.py": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    files = R.scan(spark, str(tmp_path), ["skip/"])
    assert {r.path for r in files.collect()} == {"src/a.py", "docs/d.md"}
    m = R.markdown_memories(spark, str(tmp_path)).first()
    assert (m.id, m.kind, m.status, m.severity, m.applies_to, m.tags, m.body) == ("m1", "gotcha", "active", "high", ["src/**", "a.py"], ["one", "two"], "Body here")
    again = R.parse_memories(R.memory_markdown(R.markdown_memories(spark, str(tmp_path))).selectExpr("markdown as text")).first()
    assert again.applies_to == m.applies_to and again.body == m.body
    old = files.where("path <> 'docs/d.md'").unionByName(files.where("path = 'docs/d.md'").selectExpr("'gone.py' path", "length", "modified", "sha256", "text"))
    assert {r.path: r.state for r in R.file_delta(old, files).collect()} == {"src/a.py": "Unchanged", "docs/d.md": "Indexed", "gone.py": "Deleted"}


def test_bundle_round_trip(spark, rows, tmp_path):
    data = rows("id int, v string", (1, "a"), (2, None))
    digest = R.write_bundle(data, f"{tmp_path}/b")
    back = R.read_bundle(spark, f"{tmp_path}/b", "id int, v string", digest)
    assert sorted(back.collect()) == sorted(data.collect())
    with pytest.raises(ValueError):
        R.read_bundle(spark, f"{tmp_path}/b", "id int, v string", "0" * 64)
    assert R.merge_bundle(data, rows("id int, v string", (2, None), (3, "c")), ["id", "v"]).count() == 3
