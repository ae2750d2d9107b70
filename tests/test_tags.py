from lodestone.operators import parsers, tags

SCHEMA = "repo_name string, file_path string, language string, kind string, name string, parent string, bases array<string>, calls array<string>, decorators array<string>, source string"


def row(language, kind, name, parent=None, bases=(), calls=(), decorators=(), source="", repo="r"):
    return (repo, f"{language}.x", language, kind, name, parent, list(bases), list(calls), list(decorators), source)


def test_tags(spark):
    rows = [
        row("kotlin", "class_head", "CartVM", bases=["ViewModel<X>"], decorators=["@HiltViewModel"]), row("kotlin", "method", "load", "CartVM", calls=["repo.fetch", "scope.launch"]), row("kotlin", "method", "fetch", "CartRepository"),
        row("kotlin", "method", "fetch", "Other", calls=["fetch"]), row("rust", "class_head", "Foo", source="pub struct Foo"), row("rust", "block", "impl fmt::Display for Foo<T>"), row("rust", "function", "go", calls=["x.unwrap"]), row("rust", "function", "try_it", source="a()?;"),
        row("rust", "function", "plain", source="a();"), row("swift", "class_head", "View", bases=["UIView", "CellDelegate", "Base"]), row("swift", "class_head", "Base"), row("dart", "class_head", "CounterBloc", bases=["Bloc<E, S>"]),
        row("dart", "method", "add", "CounterBloc", calls=["emit"], source="on<Added>((e) {})"), row("dart", "class_head", "Page", bases=["StatelessWidget"]), row("dart", "method", "build", "Page", calls=["CounterBloc", "Text", "ref.watch"]), row("dart", "method", "add", "Page", calls=["emit"]),
        ("q", None, "swift", "class_head", "Base2", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows + rows[:3], SCHEMA).selectExpr("*", "1 AS owner", "'x' AS base")
    got = sorted((r.name, r.tag) for r in tags.tags(df).collect())
    assert got == sorted(
        [
            ("CartVM", "@uses_repository"), ("CartVM", "@di_component"), ("load", "@coroutine_scope"), ("Foo", "@public_api"), ("Foo", "@impl_Display"), ("impl fmt::Display for Foo<T>", "@impl_Display"), ("go", "@error_propagation"), ("try_it", "@error_propagation"),
            ("View", "@conforms_to_CellDelegate"), ("View", "@delegate"), ("CounterBloc", "@bloc_state_machine"), ("add", "@emits_state"), ("add", "@bloc_event_handler"), ("build", "@widget_composer"), ("Page", "@riverpod_consumer"),
        ]
    )
    assert tags.tags(df.limit(0)).count() == 0


def test_symbols_with_sources(spark):
    f = spark.createDataFrame([(1, "rust", "pub fn go() -> i32 {\n    a()?\n}\n"), (2, "python", None)], "file_id bigint, language string, content string")
    assert [(r.name, r.source) for r in parsers.symbols(f, source=True).collect()] == [("go", "pub fn go() -> i32 {\n    a()?\n}")]
