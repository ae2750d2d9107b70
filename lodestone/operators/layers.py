"""Architectural layers of files, from folders, name suffixes and base classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The layers in order of precedence, with the folders, name suffixes and base classes that tell them.
LAYERS = ("presentation", "domain", "data", "infrastructure")
FOLDERS = {
    "presentation": ("screens", "screen", "ui", "views", "view", "pages", "page", "widgets", "widget", "components", "component", "activities", "fragments", "viewcontrollers", "viewcontroller", "customviews", "customview", "cells", "tableviewcells", "collectionviewcells", "controllers", "storyboards", "xibs", "presentation", "routes", "router", "routing", "blueprints", "blueprint", "endpoints", "handlers", "handler"),
    "domain": ("services", "service", "usecases", "usecase", "domain", "interactors", "interactor", "blocs", "bloc", "cubits", "cubit", "viewmodels", "viewmodel", "managers", "manager", "contactsmodule", "module", "modules", "features", "feature", "providers", "provider", "entities", "entity"),
    "data": ("models", "model", "repositories", "repository", "db", "database", "api", "network", "remote", "local", "datasources", "datasource", "dao", "networkmanager", "networkservice", "networking", "networkservicemanager", "data", "schemas", "schema", "serializers", "serializer"),
    "infrastructure": ("utils", "util", "helpers", "helper", "config", "configs", "constants", "constant", "di", "injection", "extensions", "extension", "utility", "utilities", "common", "shared", "base", "appdelegate", "scenedelegate", "resources", "assets", "themes", "theme", "core", "middleware"),
}
SUFFIXES = {
    "presentation": ("ViewController", "TableViewController", "CollectionViewController", "TabBarController", "View", "Cell", "Control", "Coordinator", "Router", "Screen"),
    "domain": ("ViewModel", "Presenter", "Interactor", "UseCase", "Manager", "Service", "Protocol"),
    "data": ("Repository", "DataSource", "APIClient", "NetworkManager", "ApiService", "Parser", "Mapper"),
    "infrastructure": ("AppDelegate", "SceneDelegate", "Utility", "Helper", "Extension", "Constants", "Config"),
}
SNAKE_SUFFIXES = {
    "presentation": ("_page", "_screen", "_widget", "_view"),
    "domain": ("_bloc", "_cubit", "_notifier", "_provider", "_viewmodel", "_usecase", "_entity"),
    "data": ("_repository_impl", "_repository", "_service", "_api", "_client", "_dto", "_model"),
}
BASES = {
    "presentation": ("StatefulWidget", "StatelessWidget", "ConsumerWidget", "HookWidget", "State", "InheritedWidget", "Activity", "AppCompatActivity", "ComponentActivity", "FragmentActivity", "Fragment", "DialogFragment", "BottomSheetDialogFragment", "ViewController", "UIViewController", "UIView", "UITableViewController", "UICollectionViewController", "UITabBarController", "UINavigationController", "UITableViewCell", "UICollectionViewCell", "UIControl", "Responder", "View", "APIView", "Blueprint", "APIRouter"),
    "domain": ("ViewModel", "AndroidViewModel", "StateNotifier", "ChangeNotifier", "Bloc", "Cubit", "GetxController", "Interactor", "UseCase", "NSObject", "ObservableObject"),
    "data": ("Repository", "DataSource", "Dao", "ApiService", "RoomDatabase", "ContentProvider", "Worker", "CoroutineWorker", "URLSession", "NSURLSession", "ApiClient", "Dio", "Serialize", "Deserialize", "Model", "BaseModel"),
    "infrastructure": ("App",),
}


def _longest(stem: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for suffix, layer in sorted(((s, k) for k, v in table.items() for s in v), key=lambda t: (len(t[0]), t[0])):
        out = F.when(stem.endswith(suffix), layer).otherwise(out)  # longer ones come last and win
    return out


def labels(path: Column, bases: Column | None = None) -> Column:
    """All layers that a path (and base classes) tells, in order of precedence; ['unknown'] if none does."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    folders = F.transform(parts, lambda p: F.regexp_replace(F.lower(p), r"\.[^.]*$", ""))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    camel, snake = _longest(stem, SUFFIXES), _longest(F.lower(stem), SNAKE_SUFFIXES)
    tells = []
    for layer in LAYERS:
        hit = F.arrays_overlap(folders, F.array(*map(F.lit, FOLDERS[layer]))) | F.coalesce(camel == layer, F.lit(False)) | F.coalesce(snake == layer, F.lit(False))
        if bases is not None:
            hit = hit | F.coalesce(F.arrays_overlap(bases, F.array(*map(F.lit, BASES[layer]))), F.lit(False))
        tells.append(F.when(hit, layer))
    found = F.filter(F.array(*tells), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


def top_layers(counts: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """by, layers: the commonest layers with their counts ('data:7 domain:3'); ties by name. `counts` has by, layer, n."""
    r = counts.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "layer"))).where(F.col("r") <= most)
    return r.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "layer", "n"))), lambda x: F.concat(x["layer"], F.lit(":"), x["n"].cast("string"))), " ").alias("layers"))
