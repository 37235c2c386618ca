"""Fixed values. Scores depend on every entry, so they are stated plainly and in natural order."""

from __future__ import annotations

# Frameworks in catalogue order. Earlier entries win ties.
FRAMEWORKS = ("symfony", "laravel", "codeigniter", "yii", "zend", "cakephp", "phalcon", "tempest")

# Framework -> (package, weight); the first package of each is the primary one.
CATALOGUE = {
    "symfony": [
        ("symfony/framework-bundle", 50),
        ("symfony/console", 40),
        ("symfony/http-kernel", 25),
        ("symfony/dependency-injection", 25),
    ],
    "laravel": [
        ("laravel/framework", 50),
        ("illuminate/database", 40),
        ("illuminate/support", 25),
        ("illuminate/routing", 25),
    ],
    "codeigniter": [("codeigniter/framework", 50), ("codeigniter4/framework", 40)],
    "yii": [("yiisoft/yii2", 50), ("yiisoft/yii2-bootstrap4", 40)],
    "zend": [("zendframework/zend-mvc", 50)],
    "cakephp": [("cakephp/cakephp", 50), ("cakephp/orm", 40), ("cakephp/bake", 25)],
    "phalcon": [("phalcon/phalcon", 50), ("phalcon/devtools", 40)],
    "tempest": [("tempest/framework", 50), ("tempest/core", 40), ("tempest/console", 25)],
}

# Paths whose existence points at a framework.
FINGERPRINTS = {
    "symfony": ["bin/console", "config/bundles.php", "symfony.lock"],
    "laravel": ["artisan", "app/Http/Kernel.php", "bootstrap/app.php"],
    "codeigniter": [
        "spark",
        "app/Config/App.php",
        "application/config/config.php",
        "application/controllers",
        "application/models",
        "system/codeigniter/core",
        "system/cms/controllers",
    ],
    "yii": ["yii", "config/web.php", "config/console.php"],
    "zend": ["config/application.config.php", "module/Application"],
    "cakephp": ["bin/cake", "config/app.php", "src/Application.php"],
    "phalcon": ["app/config/config.php", ".phalcon"],
    "tempest": ["vendor/tempest", ".tempest"],
}

# Detection thresholds, bonuses and version markers that halve a weight.
MIN_CERTAINTY = 40
FINGERPRINT_BONUS = 10
FINGERPRINT_ALONE = 30
UNSTABLE_MARKERS = ("dev-", "*", "@dev", "@alpha", "@beta", "@RC")

# Literals that couple a file to a framework, by kind, as they are searched.
NAMESPACE, HELPER, FACADE, BASE_CLASS = "namespace", "helper", "facade", "base_class"
SIGNATURES = {
    "laravel": {
        NAMESPACE: ["use Illuminate\\", "use Laravel\\"],
        HELPER: [
            "app(", "request(", "response(", "auth(", "session(", "view(", "config(", "route(",
            "url(", "abort(", "back(", "redirect(", "dispatch(", "cache(", "event(", "resolve(",
        ],
        FACADE: [
            "Auth::", "Cache::", "Config::", "DB::", "Event::", "File::", "Hash::", "Log::", "Mail::",
            "Notification::", "Queue::", "Route::", "Schema::", "Session::", "Storage::", "URL::",
            "Validator::", "View::",
        ],
        BASE_CLASS: [
            "extends Model", "extends Controller", "extends FormRequest", "extends Middleware",
            "extends Job", "extends Mailable", "extends Notification", "extends Resource",
            "extends Seeder", "extends Migration",
        ],
    },
    "symfony": {
        NAMESPACE: ["use Symfony\\", "use Doctrine\\Bundle\\"],
        BASE_CLASS: [
            "extends AbstractController", "extends Controller", "extends Command",
            "extends AbstractType", "extends WebTestCase", "extends KernelTestCase",
        ],
    },
    "codeigniter": {
        NAMESPACE: ["use CodeIgniter\\"],
        HELPER: [
            "base_url(", "site_url(", "show_error(", "show_404(", "redirect(", "$this->load->",
            "$this->db->", "$this->input->", "$this->session->", "$this->uri->",
            "$this->config->item(", "$this->lang->", "$this->output->", "$this->cache->",
            "$this->CI->", "get_instance()", "defined('BASEPATH')", 'defined("BASEPATH")',
        ],
        BASE_CLASS: [
            "extends BaseController", "extends CI_Controller", "extends CI_Model",
            "extends CI_Migration", "extends MY_Controller", "extends MY_Model",
        ],
    },
    "yii": {
        NAMESPACE: ["use yii\\"],
        HELPER: ["Yii::$app", "Yii::t(", "Yii::getAlias("],
        BASE_CLASS: [
            "extends Controller", "extends ActiveRecord", "extends Model", "extends Widget",
            "extends Component",
        ],
    },
    "cakephp": {
        NAMESPACE: ["use Cake\\"],
        BASE_CLASS: [
            "extends AppController", "extends AppTable", "extends AppEntity", "extends Table",
            "extends Entity",
        ],
    },
    "zend": {
        NAMESPACE: ["use Zend\\", "use Laminas\\"],
        BASE_CLASS: ["extends AbstractActionController", "extends AbstractRestfulController"],
    },
    "phalcon": {
        NAMESPACE: ["use Phalcon\\"],
        HELPER: [
            "$this->view->", "$this->request->", "$this->response->", "$this->router->", "$this->url->",
        ],
        BASE_CLASS: [
            "extends Controller", "extends Model", "extends Injectable", "extends BaseModel",
            "extends ResourceModel", "extends BaseController", "extends SecureController",
            "extends Task",
        ],
    },
    "tempest": {NAMESPACE: ["use Tempest\\"]},
}
SIGNATURE_KINDS = (NAMESPACE, HELPER, FACADE, BASE_CLASS)
HEAVY_HITS = 4

# Package name prefixes that belong to a framework.
PACKAGE_PREFIXES = {
    "laravel": [
        "laravel/", "illuminate/", "spatie/laravel-", "livewire/", "barryvdh/laravel-",
        "tymon/jwt-auth", "filament/",
    ],
    "symfony": [
        "symfony/", "doctrine/doctrine-bundle", "doctrine/doctrine-migrations-bundle",
        "easycorp/easyadmin-bundle", "knplabs/", "stof/",
    ],
    "codeigniter": ["codeigniter/", "codeigniter4/"],
    "yii": ["yiisoft/", "yii2tech/"],
    "cakephp": ["cakephp/"],
    "zend": ["zendframework/", "laminas/"],
    "phalcon": ["phalcon/"],
    "tempest": ["tempest/"],
}

# Lowest runtime (major, minor) that a target framework needs.
MINIMUM_RUNTIME = {
    "symfony": (8, 2),
    "laravel": (8, 2),
    "tempest": (8, 2),
    "cakephp": (8, 1),
    "zend": (8, 1),
    "yii": (8, 1),
    "codeigniter": (8, 1),
    "phalcon": (8, 0),
}

# Framework version that fits each runtime version, 7.0 to 8.4.
RUNTIME_VERSIONS = ("7.0", "7.1", "7.2", "7.3", "7.4", "8.0", "8.1", "8.2", "8.3", "8.4")
TARGET_VERSIONS = {
    "symfony": ["3.*", "4.*", "4.*", "5.*", "5.*", "5.*", "6.*", ">=6.*", ">=7.*", ">=7.*"],
    "laravel": ["5.4", "5.5", "5.6", "6.*", "7.*", "8.*", "9.*", "10.*", "10.*", "10.*"],
    "codeigniter": ["3.*", "3.*", "3.*", "3.*", "3.*", "4.*", "4.*", "4.*", "4.*", "4.*"],
    "yii": ["2.0", "2.0", "2.0", "2.0", "2.0", "2.0", "2.0", "2.0", "2.0", "2.0"],
    "zend": ["3.*", "3.*", "3.*", "3.*", "3.*", "3.*", "3.*", "3.*", "3.*", "3.*"],
    "cakephp": ["3.*", "3.*", "3.*", "3.*", "4.*", "4.*", "4.*", "4.*", "4.*", "4.*"],
    "phalcon": ["3.*", "3.*", "3.*", "3.*", "4.*", "4.*", "5.*", "5.*", "5.*", "5.*"],
}
EXTENSION_PENALTY = {"phalcon": 20}
TARGET_RUNTIMES = ("8.2", "8.3", "8.4")

# Weights of the component scores, in percent.
MIGRATION_WEIGHTS = {
    "framework_coupling": 30,
    "database_coupling": 20,
    "dependency_compatibility": 10,
    "architecture": 25,
    "test_coverage": 5,
    "codebase_size": 10,
}
MIGRATION_WEIGHTS_WITH_TEMPLATES = {
    "framework_coupling": 30,
    "database_coupling": 20,
    "dependency_compatibility": 10,
    "architecture": 20,
    "test_coverage": 5,
    "codebase_size": 5,
    "templating": 10,
}
UPGRADE_WEIGHTS = {
    "framework_version": 35,
    "dependencies": 30,
    "php_version": 20,
    "codebase_size": 15,
}

# Fixed values: (exclusive upper bound, label); the last label has no upper bound.
MIGRATION_BANDS = [
    (35, "Extremely Difficult Migration"),
    (55, "Very Difficult Migration"),
    (70, "Difficult Migration"),
    (85, "Moderate Migration"),
    (None, "Straightforward Migration"),
]
UPGRADE_BANDS = [(50, "Difficult Upgrade"), (80, "Medium Upgrade"), (None, "Easy Upgrade")]
LEGACY_LABELS = [
    (20, "(heavily coupled — significant rewrite work remains)"),
    (45, "(moderately coupled — meaningful work remains)"),
    (70, "(lightly coupled — manageable cleanup remaining)"),
    (None, "(minimal coupling — nearly migrated)"),
]

# Content markers of the database layers.
ELOQUENT_BASE = "extends Model"
ELOQUENT_MARKERS = ("Illuminate\\Database\\Eloquent", "use Illuminate\\")
DOCTRINE_MARKERS = ("Doctrine\\ORM\\Mapping", "#[ORM\\", "@ORM\\")
ACTIVE_RECORD_CALLS = (
    "$this->db->get(", "$this->db->where(", "$this->db->select(", "$this->db->insert(",
    "$this->db->update(", "$this->db->delete(", "$this->db->join(", "$this->db->from(",
    "$this->db->query(",
)
RAW_QUERY_MARKERS = ("->prepare(", "->query(", "PDO::", "$wpdb->", "mysqli_query(")

# Markers of coupled tests, and of logic inside templates.
COUPLED_TEST_MARKERS = (
    "Illuminate\\Foundation\\Testing", "Tests\\TestCase", "Symfony\\Bundle\\FrameworkBundle\\Test",
)
TEMPLATE_DB_MARKERS = ("$pdo->", "mysqli_", "$this->db->", "->query(")
TEMPLATE_ENDINGS = (".twig", ".blade.php", ".volt", ".tpl", ".phtml")
TEMPLATE_ENGINES = {".blade.php": "blade", ".volt": "volt", ".twig": "twig", ".tpl": "smarty"}
TEMPLATE_PACKAGES = {"twig/": "twig", "smarty/": "smarty"}
TEMPLATE_DIRS = r"(?i)/(views?|templates?|pages?|partials?|layouts?)/"

# Version-control directories that a file walk always leaves out
# (those that start with a dot are left out as hidden).
VCS_DIRS = ("_svn", "CVS", "_darcs")

# How a database driver binds each column type, under the names of common databases; anything
# else binds as STRING.
BINDING_TYPES = {
    "int": "INTEGER",
    "integer": "INTEGER",
    "smallint": "INTEGER",
    "tinyint": "INTEGER",
    "mediumint": "INTEGER",
    "int2": "INTEGER",
    "int4": "INTEGER",
    "serial": "INTEGER",
    "smallserial": "INTEGER",
    "boolean": "BOOLEAN",
    "bool": "BOOLEAN",
    "blob": "LARGE_OBJECT",
    "tinyblob": "LARGE_OBJECT",
    "mediumblob": "LARGE_OBJECT",
    "longblob": "LARGE_OBJECT",
    "bytea": "LARGE_OBJECT",
    "binary": "BINARY",
    "varbinary": "BINARY",
}

# A route definition, and a line up to the last place where one can end.
ROUTE = r"\$route\['([^\n]*?)'\] = '([^\n]*?)'"
ROUTE_END = r"^[^\n]*'\] = '[^'\n]*'"

# A constructor with a parameter whose type begins with a capital. Each run of letters is tried
# once, from its start.
CONSTRUCTOR = r"public\s+function\s+__construct\s*\([^)]*?(?<![a-zA-Z\\])[a-z\\]*+[A-Z][a-zA-Z\\]++\s++\$"
