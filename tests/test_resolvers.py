"""Fixed cases of the Rust and ECMAScript resolvers."""

import json

import pytest

from chronolith.operators import resolvers
from chronolith.plans.registry import ready


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark):
    ready(spark)


def files_of(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def answers(frame):
    return {r.import_id: r for r in frame.collect()}


def test_rust(spark):
    files = files_of(spark, "src/lib.rs", "src/tax.rs", "src/tax/rates.rs", "src/util/mod.rs", "src/util/fmt.rs", "tests/it.rs", "other/src/main.rs")
    crates = spark.createDataFrame([("Cargo.toml", ["serde_json", "my-crate"]), ("other/Cargo.toml", ["rand"])], "path string, dependencies array<string>")
    cases = [
        ("src/lib.rs", "mod", "tax", "src/tax.rs"), ("src/lib.rs", "mod", "util", "src/util/mod.rs"), ("src/tax.rs", "mod", "rates", "src/tax/rates.rs"), ("src/tax.rs", "mod", "gone", None),
        ("src/util/fmt.rs", "use", "crate::tax::rates::Rate", "src/tax/rates.rs"), ("src/util/fmt.rs", "use", "crate::Config", "src/lib.rs"), ("src/tax.rs", "use", "self::rates", "src/tax/rates.rs"),
        ("src/tax/rates.rs", "use", "super::Vat", "src/tax.rs"), ("src/util/fmt.rs", "use", "super::super::tax", "src/tax.rs"), ("src/util/mod.rs", "use", "super::tax::rates", "src/tax/rates.rs"),
        ("src/util/fmt.rs", "use", "super::super::super::x", None), ("src/lib.rs", "use", "super::x", None), ("tests/it.rs", "use", "self::x", None), ("other/src/main.rs", "use", "crate::x", "other/src/main.rs"),
        ("src/lib.rs", "use", "my_crate::x", "my-crate"), ("src/lib.rs", "use", "std::io", None), ("src/lib.rs", "use", "rand::Rng", None), ("other/src/main.rs", "use", "serde_json::x", "serde_json"),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "import_id long, path string, form string, specifier string")
    found = answers(resolvers.rust_imports(rows, files, crates))
    assert {i: found[i].target for i in found} == {i: c[3] for i, c in enumerate(cases)}
    assert found[8].method == "rust-super-path" and found[10].reason == "super:: goes above the crate root" and found[12].reason == "file is not part of the crate module tree"
    assert [found[i].kind for i in (3, 13, 14, 15, 16)] == ["unresolved", "files", "dependency", "builtin", "unresolved"]
    assert resolvers.rust_imports(rows.limit(0), files, crates).isEmpty()


FILES = (
    "src/a.ts", "src/b.ts", "src/b.js", "src/only.js", "src/dir/index.ts", "src/pkg/package.json", "src/pkg/main.js", "src/assert.ts", "apps/web/tsconfig.json", "apps/web/src/main.ts", "apps/web/src/lib/x.ts",
    "tsconfig.base.json", "configs/tsconfig.lib.json", "packages/ui/tsconfig.json", "packages/ui/index.ts", "shared/date.ts", "svc/tsconfig.json", "svc/tsconfig.base.json", "svc/src/main.ts", "svc/src/tools/time.ts", "svc/src/lib/y.ts",
    "loop/tsconfig.json", "loop/other.json", "loop/m.ts", "broken/tsconfig.json", "broken/m.ts", "package.json", "packages/core/package.json", "packages/core/src/index.ts",
)
CONFIGS = {
    "apps/web/tsconfig.json": '\ufeff{ // aliases\n "extends": "../../tsconfig.base.json", "compilerOptions": {"paths": {"@/*": ["./src/*",], "events": ["./src/lib/x.ts"], "bad/*/*": ["x"], "lost/*": ["./none/*"]},}, /* end */ }',
    "tsconfig.base.json": json.dumps({"compilerOptions": {"paths": {"#shared/*": ["./shared/*"], "#shared/d*": ["./shared/d*"]}}}),
    "configs/tsconfig.lib.json": json.dumps({"extends": "../tsconfig.base.json"}),
    "packages/ui/tsconfig.json": json.dumps({"extends": ["../../../outside.json", "../../configs/tsconfig.lib"]}),
    "svc/tsconfig.base.json": json.dumps({"compilerOptions": {"baseUrl": "./src"}}),
    "svc/tsconfig.json": json.dumps({"extends": "./tsconfig.base.json", "compilerOptions": {"paths": {"@lib/*": ["lib/*"]}}}),
    "loop/tsconfig.json": json.dumps({"extends": "./other.json"}),
    "loop/other.json": json.dumps({"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "../.."}}),
    "broken/tsconfig.json": "{",
}
PACKAGES = [("package.json", None, {}, ["react", "@scope/kit"]), ("packages/core/package.json", "@own/core", {".": ["./dist/index.js", "./src/index.ts"]}, ["left-pad"]), ("src/pkg/package.json", "inner", {".": ["./main"]}, [])]
CASES = [
    ("src/a.ts", "./b", "src/b.ts", "relative-path"), ("src/a.ts", "./b.js", "src/b.ts", "relative-path"), ("src/only.js", "./b.js", "src/b.js", "relative-path"), ("src/a.ts", "./dir/", "src/dir/index.ts", "relative-path"),
    ("src/a.ts", "./pkg", "src/pkg/main.js", "relative-path"), ("src/a.ts", "../../x", None, None), ("src/a.ts", "./gone", None, None), ("src/a.ts", "/abs", None, None), ("src/a.ts", "node:fs", None, None), ("src/a.ts", "fs/promises", None, None),
    ("src/a.ts", "react/jsx", "react", "declared-package"), ("src/a.ts", "@scope/kit/sub", "@scope/kit", "declared-package"), ("src/a.ts", "left-pad", None, None), ("packages/core/src/index.ts", "left-pad", "left-pad", "declared-package"),
    ("src/a.ts", "@own/core", "packages/core/src/index.ts", "workspace-package-entry"), ("src/a.ts", "@own/core/x", None, None),
    ("apps/web/src/main.ts", "@/lib/x", "apps/web/src/lib/x.ts", "tsconfig-paths:apps/web/tsconfig.json#@/*"), ("apps/web/src/main.ts", "events", "apps/web/src/lib/x.ts", "tsconfig-paths:apps/web/tsconfig.json#events"),
    ("apps/web/src/main.ts", "lost/y", None, None), ("apps/web/src/main.ts", "#shared/date", None, None),
    ("packages/ui/index.ts", "#shared/date", "shared/date.ts", "tsconfig-paths:tsconfig.base.json##shared/d*"), ("svc/src/main.ts", "@lib/y", "svc/src/lib/y.ts", "tsconfig-paths:svc/tsconfig.json#@lib/*"),
    ("svc/src/main.ts", "tools/time", "svc/src/tools/time.ts", "tsconfig-base-url:svc/tsconfig.base.json"), ("svc/src/main.ts", "assert", None, None), ("loop/m.ts", "anything", None, None), ("broken/m.ts", "src/a", None, None),
]


def test_ecmascript(spark):
    files = files_of(spark, *FILES)
    configs = resolvers.read_configs(spark.createDataFrame(list(CONFIGS.items()), "path string, content string"))
    packages = spark.createDataFrame(PACKAGES, "path string, name string, entries map<string,array<string>>, dependencies array<string>")
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "import_id long, path string, specifier string")
    found = answers(resolvers.ecmascript_imports(rows, files, configs, packages))
    assert {i: (found[i].target, found[i].method) for i in found} == {i: c[2:] for i, c in enumerate(CASES)}
    reasons = {i: found[i].reason for i in (5, 6, 7, 12, 15, 18, 19)}
    assert reasons == {
        5: "path escapes the repository", 6: "no file matches the relative path", 7: "absolute paths are not portable", 12: "package left-pad is not declared in any package.json above the file",
        15: "workspace package @own/core has no existing entry for ./x", 18: "tsconfig path lost/* in apps/web/tsconfig.json matched but no target file exists", 19: "package #shared is not declared in any package.json above the file",
    }
    assert {i for i in found if found[i].kind == "builtin"} == {8, 9, 23}
    assert resolvers.ecmascript_imports(rows.limit(0), files, configs, packages).isEmpty()


def test_later_extends_entries_override_earlier_ones(spark):
    contents = {"a.json": {"compilerOptions": {"paths": {"~/*": ["./a/*"]}, "baseUrl": "a"}}, "b.json": {"compilerOptions": {"paths": {"~/*": ["./b/*"]}}}, "app/tsconfig.json": {"extends": ["../a.json", "../b.json"]}, "app/sub/tsconfig.json": {"extends": "../tsconfig.json", "compilerOptions": {"paths": {"~/*": ["./own/*"]}}}}
    files = files_of(spark, *contents)
    configs = resolvers.read_configs(spark.createDataFrame([(p, json.dumps(c)) for p, c in contents.items()], "path string, content string"))
    found = {r.config: r for r in resolvers.effective_configs(configs, files).collect()}
    assert found["app/tsconfig.json"].paths_in == "b.json" and found["app/tsconfig.json"].base_in == "a.json" and found["app/tsconfig.json"].base_dir == "a"
    assert found["app/sub/tsconfig.json"].paths_in == "app/sub/tsconfig.json" and found["app/sub/tsconfig.json"].base_in == "a.json"


def test_configuration_text():
    assert resolvers.parse_config('{"a": "// no, /* comment */ ,}", "extends": 5}') == ([], None, None)
    assert resolvers.parse_config("[]") is None and resolvers.parse_config("{/*") is None
    assert resolvers.parse_config('{"compilerOptions": {"baseUrl": ".", "paths": {"x": "y", "z": ["a*b*", 3, "c"],},},}') == ([], ".", [{"pattern": "x", "targets": ["y"]}, {"pattern": "z", "targets": ["c"]}])


SUFFIX_FILES = ("src/main/java/com/acme/tax/Rates.java", "src/main/java/com/acme/tax/Vat.java", "src/main/java/com/acme/shop/Cart.java", "a/util/Dup.java", "b/util/Dup.java", "Shop/Cart.cs", "lib/shop/cart.rb", "lib/shop/tax/rates.rb", "lib/shop.rb", "app/shop/cart.rb", "x/dup.rb", "y/dup.rb", "src/Tax/Rates.php", "src/Shop/Cart.php", "src/helpers.php", "Top.java")
TAX = ["src/main/java/com/acme/tax/Rates.java", "src/main/java/com/acme/tax/Vat.java"]
SUFFIX_CASES = [
    ("java", "import", "s/A.java", "com.acme.tax.Rates", "files", TAX[:1]), ("java", "import", "s/A.java", "com.acme.tax.Rates.Inner", "files", TAX[:1]), ("java", "import", "s/A.java", "com.acme.tax.*", "files", TAX), ("java", "import", "s/A.java", "util.*", "unresolved", None),
    ("java", "import", "s/A.java", "java.util.List", "builtin", None), ("java", "import", "s/A.java", "util.Dup", "unresolved", None), ("java", "import", "s/A.java", "org.junit.Test", "unresolved", None), ("java", "import", "s/A.java", "Top", "files", ["Top.java"]),
    ("csharp", "using", "Shop/Cart.cs", "System.Linq", "builtin", None), ("csharp", "using", "Shop/Cart.cs", "Acme.Tax", "unresolved", None),
    ("ruby", "require", "lib/shop/cart.rb", "./tax/rates", "files", ["lib/shop/tax/rates.rb"]), ("ruby", "require", "bin/run.rb", "shop/cart", "files", ["lib/shop/cart.rb"]), ("ruby", "require", "bin/run.rb", "json", "builtin", None), ("ruby", "require", "bin/run.rb", "rails", "unresolved", None),
    ("ruby", "require", "bin/run.rb", "dup.rb", "unresolved", None), ("ruby", "require", "bin/run.rb", "../../x", "unresolved", None), ("php", "require", "src/Shop/Cart.php", "./../helpers.php", "files", ["src/helpers.php"]), ("php", "require", "src/Shop/Cart.php", "src/helpers.php", "files", ["src/helpers.php"]),
    ("php", "use", "src/Shop/Cart.php", "App\\Tax\\Rates", "files", ["src/Tax/Rates.php"]), ("php", "use", "src/Shop/Cart.php", "\\Vendor\\Lib\\Thing", "unresolved", None),
]


def test_java_csharp_ruby_and_php(spark):
    rows = spark.createDataFrame([(i, c[2], c[0], c[1], c[3]) for i, c in enumerate(SUFFIX_CASES)], "import_id long, path string, language string, form string, specifier string")
    found = answers(resolvers.suffix_imports(rows, files_of(spark, *SUFFIX_FILES)))
    assert {i: (r.kind, r.targets) for i, r in found.items()} == {i: c[4:] for i, c in enumerate(SUFFIX_CASES)}
    assert found[3].reason == "package util.* matches several directories" and found[5].reason == "class util.Dup matches several files" and found[14].reason == "dup.rb matches several files" and found[9].reason == "C# namespaces are not tied to files"
    assert found[0].confidence == 0.9 and found[10].confidence == 1.0 and found[11].method == "ruby-load-path" and found[17].method == "php-require"


def test_first_files_moves_a_base_once(spark):
    """Each base was a row for each of some 25 paths that it may stand for; result and order are those of trying them one by one."""
    known = {"a.ts", "a.d.ts", "a.js.ts", "p/a.tsx", "p/index.ts", "p/index.d.ts", "index.js", "p/b.cjs", "p/b.cts", "/index.ts", "p/q.mts", "p/q/index.mjs"}
    bases = ["", "a", "a.d", "a.js", "p", "p/a.js", "p/a.jsx", "p/b.cjs", "p/b", "p/q.mjs", "p/q", "p/index", "none"]
    rows = [(f"{base} {typed} {turn}", turn, base, typed) for base in bases for typed in (True, False) for turn in (0, 1)] + [("two", 1, "a", True), ("two", 0, "p", True)]
    entries = {"none": ("../p/b", "p/b"), "p": ("./q", "p/q")}

    def tried(base, typed):
        stem, dot, end = base.rpartition(".")
        yield from (stem + source for source in resolvers.ES_SOURCES.get(dot + end, ()) if typed)
        yield from (base + e for e in ("", *resolvers.ES_EXTENSIONS) if base)
        yield from (entries[base][1] + e for e in ("", *resolvers.ES_EXTENSIONS) if base in entries)
        yield from ((base + "/" if base else "") + "index" + e for e in resolvers.ES_EXTENSIONS)

    want = {}
    for id_, _, base, typed in sorted(rows, key=lambda row: row[1]):
        hit = next((p for p in tried(base, typed) if p in known), None)
        if hit:
            want.setdefault(id_, hit)
    frame = spark.createDataFrame(rows, "import_id string, turn int, base string, typed boolean")
    at = spark.createDataFrame([(d, to) for d, (to, _) in entries.items()], "dir string, target string")
    found = resolvers.first_files(frame, spark.createDataFrame([(p,) for p in known], "path string"), at)
    assert {tuple(r) for r in found.collect()} == set(want.items())
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
