"""Tags of symbols by what a language's frameworks make of them: state machines, scopes, conformances, error paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names whose meaning the tags rest on.
COROUTINES = ("launch", "async", "withContext", "runBlocking", "coroutineScope", "supervisorScope")
INJECTION = ("@HiltViewModel", "@Singleton", "@Inject", "@HiltAndroidApp", "@AndroidEntryPoint", "@Component", "@Module", "@Provides")
FALLIBLE = ("unwrap", "expect", "unwrap_or", "unwrap_or_else", "unwrap_or_default", "ok_or", "map_err")
SWIFT_CLASSES = (
    "NSObject", "UIViewController", "UIView", "UITableViewController", "UICollectionViewController", "UINavigationController", "UITabBarController", "UIControl", "UIScrollView", "UITableViewCell", "UICollectionViewCell", "ObservableObject",
)
WIDGETS = ("StatelessWidget", "StatefulWidget", "ConsumerWidget", "HookWidget", "@flutter_widget")
MACHINES = ("Bloc", "Cubit")

_WHERE = ["repo_name", "file_path"]


def _plain(c: Column) -> Column:
    """A type without its arguments."""
    return F.trim(F.regexp_extract(c, r"^([^<]*)", 1))


def _called(calls: Column) -> Column:
    """Bare names of what is called."""
    return F.transform(calls, lambda c: F.regexp_extract(c, r"([^.(]*)(?:\(.*)?$", 1))


def _any_of(items: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(items, F.array(*map(F.lit, names)))


def tags(symbols: DataFrame) -> DataFrame:
    """repo_name, file_path, parent, name, tag: each tag of each symbol once.

    `symbols` has repo_name, file_path, language, kind, name, parent, bases, calls, decorators, source. Null lists count as empty, a null source as ''. Names
    are looked up within their repository. Lookup tables have one row a name, so no join multiplies rows.
    """
    none = F.array().cast("array<string>")
    s = symbols.withColumns({c: F.coalesce(c, none) for c in ("bases", "calls", "decorators")} | {"source": F.coalesce("source", F.lit(""))})
    s = s.withColumns({"types": F.transform("bases", _plain), "called": _called(F.col("calls"))})
    # flags first: sources go no further
    flags = {
        "error": F.col("source").contains("?") | _any_of(F.col("called"), FALLIBLE), "public": F.col("source").rlike(r"\bpub\b"), "handles": F.col("source").rlike(r"\bon<\w+>"),
        "injected": F.exists("decorators", lambda d: reduce(lambda a, b: a | b, (d.startswith(x) for x in INJECTION))) | reduce(lambda a, b: a | b, (F.col("source").contains(x) for x in INJECTION)),
    }
    s = s.withColumns(flags).drop("source")
    code, head = F.col("kind").isin("function", "method"), F.col("kind") == "class_head"
    one = lambda rows, tag: rows.select(*_WHERE, "parent", "name", (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"))
    of_class = lambda rows, tag: rows.select(*_WHERE, F.lit(None).cast("string").alias("parent"), F.col("owner").alias("name"), F.lit(tag).alias("tag"))
    classes = s.where(head).select("repo_name", "name").distinct()
    lang = lambda name: s.where(F.col("language") == name)
    inside = lambda rows, owners: rows.where("parent IS NOT NULL").withColumn("owner", F.col("parent")).join(owners, [*_WHERE, "owner"], "left_semi")
    heads = lambda rows: rows.select(*_WHERE, F.col("name").alias("owner")).distinct()
    out = []

    kotlin = lang("kotlin")
    models = heads(kotlin.where(head & F.exists("types", lambda b: b.contains("ViewModel"))))
    stored = s.where(F.coalesce("parent", "name").endswith("Repository")).select("repo_name", F.col("name").alias("callee")).distinct()
    asks = inside(kotlin.where(code), models).select(*_WHERE, "owner", F.explode("called").alias("callee")).join(stored, ["repo_name", "callee"], "left_semi")
    out += [of_class(asks, "@uses_repository"), one(kotlin.where(_any_of(F.col("called"), COROUTINES)), "@coroutine_scope"), one(kotlin.where(head & F.col("injected")), "@di_component")]

    rust = lang("rust")
    implements = rust.withColumns({"trait": F.regexp_extract("name", r"^impl(?:<[^>]*>)?\s+(?:\w+::)*(\w+)\s+for\s", 1), "owner": F.regexp_extract("name", r"\sfor\s+(?:\w+::)*(\w+)(?:<.*>)?$", 1)}).where("trait <> '' AND owner <> ''")
    own = implements.join(classes.withColumnRenamed("name", "owner"), ["repo_name", "owner"], "left_semi").select(*_WHERE, F.lit(None).cast("string").alias("parent"), F.col("owner").alias("name"), F.concat(F.lit("@impl_"), "trait").alias("tag"))
    out += [one(implements, F.concat(F.lit("@impl_"), F.col("trait"))), own, one(rust.where(code & F.col("error")), "@error_propagation"), one(rust.where("public"), "@public_api")]

    swift = lang("swift").where(head)
    based = swift.select(*_WHERE, "parent", "name", F.explode("types").alias("base")).where((F.col("base") != "") & ~F.col("base").isin(*SWIFT_CLASSES))
    protocols = based.join(classes.withColumnRenamed("name", "base"), ["repo_name", "base"], "left_anti")
    out += [one(protocols, F.concat(F.lit("@conforms_to_"), F.col("base"))), one(protocols.where(F.col("base").endswith("Delegate")), "@delegate"), one(swift.where(F.col("name").endswith("Delegate")), "@delegate")]

    dart = lang("dart")
    machines = heads(dart.where(head & _any_of(F.col("types"), MACHINES)))
    widgets = heads(dart.where(head & _any_of(F.col("types"), WIDGETS)))
    builds = inside(dart.where(code & (F.col("name") == "build")), widgets).withColumn("shown", F.explode("calls")).where(F.col("shown").rlike("^[A-Z]")).join(classes.withColumnRenamed("name", "shown"), ["repo_name", "shown"], "left_semi")
    in_machine = inside(dart.where(code), machines)
    reads = F.exists("calls", lambda c: c.startswith("ref.watch") | c.startswith("ref.read"))
    out += [
        of_class(machines, "@bloc_state_machine"), one(builds, "@widget_composer"), one(in_machine.where(F.exists("calls", lambda c: (c == "emit") | c.startswith("emit("))), "@emits_state"), one(in_machine.where("handles"), "@bloc_event_handler"),
        of_class(dart.where(reads).withColumn("owner", F.coalesce("parent", "name")), "@riverpod_consumer"),
    ]
    return reduce(DataFrame.unionByName, out).distinct()
