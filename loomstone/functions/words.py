"""Word lists, labels and scores that results are defined by."""

BUSINESS_WORDS = (
    "invoice tax price amount total vat payment customer vendor supplier order po contract employee salary account balance journal asset"
).split()
GENERIC_WORDS = "add sum values calculate compute process handle run do get set data item".split()
#: In order: the first domain with a token wins.
NAME_DOMAINS = {
    "email": "email mail", "username": "user username login", "tax": "tax vat", "price": "price cost amount",
    "database": "db database connection connect host port sql", "inventory": "stock inventory qty warehouse",
    "finance": "payment invoice currency discount", "summary": "summary report reporting", "name": "name first last full",
}
STOP_WORDS = "the a an and or to of in on for with by is are this that".split()
ACTION_WORDS = (
    "calculate compute generate create build update delete remove fetch load save store validate check compare analyze scan process merge "
    "rollback recover archive cleanup parse extract convert transform verify read write"
).split()
SYNONYMS = {
    "calculate": "compute sum total", "compute": "calculate derive", "delete": "remove erase", "remove": "delete discard",
    "fetch": "load retrieve read", "load": "fetch read", "save": "store persist write", "store": "save persist",
    "validate": "check verify authenticate", "check": "validate verify", "recover": "restore", "rollback": "restore revert",
    "cleanup": "prune trim", "parse": "extract read", "extract": "parse retrieve", "convert": "transform", "transform": "convert",
    "verify": "validate authenticate", "authenticate": "validate verify authorize", "restore": "recover rollback revert",
}
PURPOSE_ACTIONS = (
    "process validate save store delete remove fetch load generate calculate update send notify transform convert extract parse rollback "
    "restore recover archive authenticate authorize verify"
).split()
#: In order: of equal counts the first domain wins.
PURPOSE_DOMAINS = {
    "payment_processing": "payment refund invoice billing transaction charge",
    "authentication": "auth login token password credential session authenticate authentication authorize authorization verify validation",
    "database_operations": "db database query insert update delete fetch select record restore recover",
    "file_processing": "file csv json xml document upload download",
    "notification_system": "notify email sms alert message mail",
    "recovery_operations": (
        "rollback restore recover recovery backup transaction revert restore_backup rollback_transaction database_restore database_rollback "
        "failover rollback_database recover_database"
    ),
}
BEHAVIOUR_CALLS = {
    "FILE_WRITE": "write writelines dump save copy copy2", "FILE_READ": "read readlines load open exists",
    "DELETE_OPERATION": "remove unlink delete rmdir", "NETWORK_OPERATION": "request post put socket send",
    "DATABASE_OPERATION": "execute commit rollback cursor connect", "AUTH_OPERATION": "authenticate authorize login logout token validate_user",
    "BACKUP_OPERATION": "create_backup backup", "RECOVERY_OPERATION": "restore_backup recover rollback",
    "MEMORY_OPERATION": "store_memory load_memory get_memory store_approved_decision",
    "STATE_MUTATION": "append extend insert update write save copy copy2",
}
HIGH_IMPACT = ("DELETE_OPERATION", "AUTH_OPERATION", "DATABASE_OPERATION", "RECOVERY_OPERATION")
OPPOSING = (
    ("BACKUP_OPERATION", "RECOVERY_OPERATION"), ("BACKUP_OPERATION", "DELETE_OPERATION"),
    ("FILE_WRITE", "DELETE_OPERATION"), ("DATABASE_OPERATION", "DELETE_OPERATION"),
)
RISK_POINTS = {"LOW": 0, "MEDIUM": 50, "HIGH": 100}
PATCH_SCORES = {
    "print_to_logger": 10, "logging_cleanup": 15, "missing_try_except": 40, "refactor_function": 50, "business_logic_change": 70,
    "authentication_change": 75, "database_change": 90, "file_deletion": 95, "payment_logic_change": 100,
}
DANGEROUS_CALLS = {
    "os.remove": ("DELETE_OPERATION", "REVIEW"), "os.unlink": ("DELETE_OPERATION", "REVIEW"), "shutil.rmtree": ("DELETE_OPERATION", "BLOCK"),
    "requests.get": ("NETWORK_OPERATION", "REVIEW"), "requests.post": ("NETWORK_OPERATION", "REVIEW"),
    "subprocess.run": ("PROCESS_OPERATION", "REVIEW"), "subprocess.Popen": ("PROCESS_OPERATION", "REVIEW"),
    "eval": ("DYNAMIC_EXEC", "BLOCK"), "exec": ("DYNAMIC_EXEC", "BLOCK"),
}
GLOBAL_STATE = "DATABASE DB CACHE STATE REGISTRY _REGISTRY _CACHE _STATE STORE _STORE".split()
#: Score bands: lowest score, label, action.
BANDS = ((0, "LOW", "AUTO_APPLY"), (30, "MEDIUM", "BATCH_APPROVAL"), (60, "HIGH", "INDIVIDUAL_APPROVAL"), (80, "CRITICAL", "FREEZE_PATCH"))
#: A type on the left removes those on the right.
TYPE_HIERARCHY = {
    "ERP_SYSTEM": ("DATABASE_SYSTEM", "WEB_APPLICATION"),
    "COMPILER_TOOLCHAIN": ("CLI_TOOL", "DATA_ENGINEERING"),
    "OPERATING_SYSTEM": ("WEB_APPLICATION", "CLI_TOOL", "DATABASE_SYSTEM"),
    "DATABASE_SYSTEM": ("DATA_ENGINEERING",),
    "NLP_TOOL": ("ML_PIPELINE", "CLI_TOOL", "FRONTEND_APPLICATION", "DATA_ENGINEERING", "LIBRARY_FRAMEWORK"),
    "AUDIO_PROCESSING": ("ML_PIPELINE", "CLI_TOOL", "NLP_TOOL", "LIBRARY_FRAMEWORK", "SIMULATION_TOOL"),
    "COMPUTER_VISION": ("ML_PIPELINE", "CLI_TOOL", "NLP_TOOL", "LIBRARY_FRAMEWORK", "GIS_SYSTEM"),
    "ENERGY_SYSTEM": ("DATA_ENGINEERING", "ML_PIPELINE", "GIS_SYSTEM", "GRAPH_ANALYTICS", "SIMULATION_TOOL"),
    "SPACE_SYSTEM": ("SCIENTIFIC_COMPUTING", "DATA_ENGINEERING"),
    "GRAPH_ANALYTICS": ("DATA_ENGINEERING", "ML_PIPELINE", "SCIENTIFIC_COMPUTING", "LIBRARY_FRAMEWORK", "SIMULATION_TOOL"),
    "EMBEDDED_SYSTEM": ("CLI_TOOL", "ML_PIPELINE", "FRONTEND_APPLICATION", "DATA_ENGINEERING", "LIBRARY_FRAMEWORK", "SECURITY_TOOL"),
    "ML_PIPELINE": ("NLP_TOOL", "AUDIO_PROCESSING", "COMPUTER_VISION"),
    "OPTIMIZATION_TOOL": ("DATA_ENGINEERING", "ML_PIPELINE"),
    "ROBOTICS_SYSTEM": ("CLI_TOOL", "ML_PIPELINE", "WEB_APPLICATION", "DATA_ENGINEERING", "LIBRARY_FRAMEWORK"),
    "MEDICAL_SYSTEM": ("ML_PIPELINE", "DATA_ENGINEERING"),
    "QUANTUM_COMPUTING": ("ML_PIPELINE", "SCIENTIFIC_COMPUTING"),
    "SECURITY_TOOL": ("CLI_TOOL", "NETWORK_TOOL", "EMBEDDED_SYSTEM", "LIBRARY_FRAMEWORK"),
    "SIMULATION_TOOL": ("DATA_ENGINEERING", "ML_PIPELINE", "GRAPH_ANALYTICS", "LIBRARY_FRAMEWORK", "CLI_TOOL"),
    "BLOCKCHAIN_NODE": ("DATABASE_SYSTEM", "CLI_TOOL"),
    "GIS_SYSTEM": ("DATA_ENGINEERING", "ML_PIPELINE"),
    "FINANCE_SYSTEM": ("DATA_ENGINEERING", "ML_PIPELINE"),
    "CAD_SYSTEM": ("CLI_TOOL", "DATA_ENGINEERING"),
    "DOCUMENT_PROCESSING": ("CLI_TOOL", "DATA_ENGINEERING"),
    "ENVIRONMENTAL": ("DATA_ENGINEERING", "GIS_SYSTEM"),
    "FPGA_HARDWARE": ("CLI_TOOL", "LIBRARY_FRAMEWORK", "EMBEDDED_SYSTEM"),
    "FIRMWARE": ("CLI_TOOL", "EMBEDDED_SYSTEM", "LIBRARY_FRAMEWORK"),
    "DSP_TOOL": ("AUDIO_PROCESSING", "CLI_TOOL", "LIBRARY_FRAMEWORK"),
    "MOBILE_APPLICATION": ("FRONTEND_APPLICATION", "CLI_TOOL", "GAME_ENGINE", "MEDIA_STREAMING"),
    "CLOUD_INFRASTRUCTURE": ("DEVOPS_TOOLING", "CLI_TOOL", "DATA_ENGINEERING"),
    "CONTAINER_ORCHESTRATION": ("DEVOPS_TOOLING", "CLI_TOOL", "LIBRARY_FRAMEWORK", "DATA_ENGINEERING"),
    "CI_CD_PIPELINE": ("DEVOPS_TOOLING", "CLI_TOOL"),
    "MEDIA_STREAMING": ("AUDIO_PROCESSING", "COMPUTER_VISION", "CLI_TOOL", "LIBRARY_FRAMEWORK", "ML_PIPELINE"),
    "DRONE_UAV": ("ROBOTICS_SYSTEM", "CLI_TOOL", "EMBEDDED_SYSTEM"),
    "CLIMATE_SCIENCE": ("SCIENTIFIC_COMPUTING", "DATA_ENGINEERING", "GRAPH_ANALYTICS", "LIBRARY_FRAMEWORK", "GIS_SYSTEM"),
}
#: Domains that are a business's core, and those that serve any, upper-cased.
CORE_DOMAINS = (
    "FINANCE_SYSTEM", "ERP_SYSTEM", "SAP_SYSTEM", "MEDICAL_SYSTEM", "AEROSPACE_SYSTEM", "ROBOTICS_SYSTEM", "FPGA_SYSTEM", "HARDWARE_SYSTEM",
    "ENERGY_SYSTEM", "MANUFACTURING_SYSTEM", "CLIMATE_SCIENCE_SYSTEM", "SCIENTIFIC_SYSTEM", "DEFENSE_SYSTEM", "AUTOMOTIVE_SYSTEM", "TELECOM_SYSTEM",
    "CLIMATE_SCIENCE", "FPGA_HARDWARE", "ML_PIPELINE",
)
SERVING_DOMAINS = (
    "WEB_PROTOCOL", "WEB_APPLICATION", "DATA_SYSTEM", "NETWORK_IO", "API_SERVICE", "DATA_PIPELINE", "DEVOPS_SYSTEM", "CLI_TOOL", "WEB", "DATA",
    "DEVOPS", "API",
)
#: Helper functions of a web framework, and names of class attributes that hold classes.
FRAMEWORK_HELPERS = ("jsonify", "redirect", "render_template", "render_template_string", "send_file", "send_from_directory", "stream_with_context", "url_for")
CLASS_ALIASES = ("response_class", "session_class")
#: Methods of text, list, dict and set.
BUILTIN_METHODS = (
    "endswith", "startswith", "strip", "lstrip", "rstrip", "split", "rsplit", "replace", "lower", "upper", "title", "join", "format", "encode",
    "append", "extend", "insert", "remove", "pop", "clear", "sort", "reverse", "copy", "count", "index",
    "get", "keys", "values", "items", "update", "popitem", "setdefault",
    "add", "discard", "union", "intersection", "difference",
)
#: Quoted words that are no names of a project, by class; keywords and builtins are those of the language.
HTTP_WORDS = (
    "GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE", "HTTP", "HTTPS", "HTML", "CSS", "JSON", "XML", "URL", "URI", "API",
    "ASGI", "WSGI", "CLI", "SQL", "TCP", "UDP", "REST", "CORS", "CSRF", "MIME", "UTF", "ASCII", "UUID", "SameSite", "HttpOnly", "Secure", "Lax",
    "Strict", "Expires", "Host", "Location", "Domain", "Path", "Origin", "Referer", "Cookie", "Accept", "Authorization", "ETag", "Vary", "Allow",
    "Age", "Date", "Server", "DocumentRoot", "LoadModule", "ProxyPass", "ServerName", "Listen", "WSGIServer", "WSGIDaemonProcess",
    "WSGIScriptAlias", "JavaScript", "jQuery", "XMLHttpRequest", "Promise", "FormData", "Response", "Request", "Window", "Document", "Event",
)
DEPENDENCY_WORDS = (
    "PyPI", "Gunicorn", "Werkzeug", "Jinja", "Jinja2", "Click", "blinker", "Blinker", "itsdangerous", "ItsDangerous", "MarkupSafe", "Python",
    "pip", "venv", "virtualenv", "pytest", "setuptools", "wheel", "Quart", "Watchdog", "watchdog", "Gevent", "gevent", "greenlet", "eventlet",
    "asgiref", "hypercorn", "uvicorn", "SQLAlchemy", "sqlalchemy", "redis", "celery", "MongoEngine", "mongoengine", "WTForms", "wtforms",
    "Waitress", "waitress", "uWSGI", "uwsgi", "SQLite", "sqlite3", "PostgreSQL", "MySQL", "Peewee", "peewee", "Marshmallow", "marshmallow",
    "cryptography", "requests", "aiohttp", "httpx", "tornado", "HTTPException", "LocalProxy", "BadRequest", "NotFound", "Response", "Request",
    "Map", "Rule", "Headers", "MultiDict", "SecureCookie", "Client", "TestResponse",
)
STDLIB_WORDS = (
    "timedelta", "datetime", "date", "time", "json", "os", "sys", "re", "io", "abc", "enum", "typing", "logging", "functools", "itertools",
    "collections", "pathlib", "decimal", "uuid", "hashlib", "base64", "asyncio", "threading", "socket", "struct", "pickle", "copy", "math",
    "contextvars", "contextlib", "warnings", "traceback", "inspect", "importlib", "types", "weakref", "gc", "signal", "atexit", "tempfile",
    "shutil", "subprocess", "getpass", "secrets", "hmac", "urllib",
)
EXAMPLE_WORDS = (
    "app", "db", "client", "self", "cls", "request", "session", "response", "e", "f", "g", "x", "y", "z", "i", "j", "k", "n", "data", "result",
    "args", "kwargs", "config", "name", "value", "key", "item", "obj", "message", "category", "context", "template", "rule", "defaults", "person",
    "user", "headers", "payload", "endpoint", "func", "view", "handler", "callback", "path", "url", "params", "query", "body", "content", "text",
    "html", "form", "field", "error", "exc", "err", "msg", "code", "status", "options", "kwarg", "arg", "default", "values", "keys", "items",
    "count", "index", "start", "end", "size", "length", "output", "input", "buffer", "stream", "chunk", "line", "row", "col", "cell", "node",
    "edge", "tree", "email", "password", "username", "token", "secret", "id", "uid", "pk", "file", "files", "foo", "bar", "baz", "spam", "eggs",
    "yourapplication", "yourapp", "myapp", "mymodule", "mypackage", "example", "sample", "demo",
)
