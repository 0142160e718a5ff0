"""These have to equal the published ones for results to be right."""

# Feature names, in their published order.
NODE_FEATURES = (
    "cpu_rate",
    "memory_rate",
    "net_rx_bytes",
    "net_tx_bytes",
    "latency_p90_ms",
    "latency_p99_ms",
    "workload_ops",
    "success_rate",
)
# The fourth edge feature is published as a p99 but computed as a maximum, so it is named for what it is.
EDGE_FEATURES = ("call_count", "error_rate", "avg_latency_ms", "max_latency_ms")
CONTEXT_FEATURES = ("total_qps", "avg_success_rate", "active_services")

# Service names that win over the generic pod-name rule.
KNOWN_SERVICES = (
    "frontend",
    "cartservice",
    "checkoutservice",
    "currencyservice",
    "emailservice",
    "paymentservice",
    "productcatalogservice",
    "recommendationservice",
    "shippingservice",
    "adservice",
)

# Column positions in a pod metric file.
METRIC_POSITIONS = {
    "ts": 1,
    "pod": 2,
    "cpu": 4,
    "mem": 6,
    "net_rx": 9,
    "net_tx": 10,
    "p90_s": 11,
    "p99_s": 15,
    "ops": 17,
    "success": 18,
}

# KPI categories; the first pattern found in the name wins, letter case ignored.
KPI_PATTERNS = (
    ("cpu", "CpuPercent$|cpu.*percent|cpu_percent|CPU.*CPUCpuUtil"),
    ("mem", "MemPercent$|mem.*percent|mem_percent"),
    ("mem_usage", "MemUsage$|mem_used|mem.*usage"),
    ("net_rx", "NetworkRxBytes$|rx_bytes|net.*rx|Incoming_network"),
    ("net_tx", "NetworkTxBytes$|tx_bytes|net.*tx|Outgoing_network"),
    ("disk_io", "Disk_|disk.*io"),
    ("threads", "thread.*used|thread.*pct"),
    ("sessions", "session.*used"),
    ("fgc", "fgc|full.*gc"),
    ("mysql_io", "Innodb|mysql.*io"),
    ("jvm_cpu", "jvm.*cpu"),
    ("jvm_mem", "jvm.*mem|JVM.*heap|JVM.*OOM"),
)

# Feature slot of each KPI category; categories that share a slot are added up.
KPI_SLOTS = {
    "cpu": 0,
    "mem": 1,
    "mem_usage": 1,
    "net_rx": 2,
    "net_tx": 3,
    "disk_io": 4,
    "threads": 5,
    "sessions": 5,
    "fgc": 6,
    "mysql_io": 4,
    "jvm_cpu": 0,
    "jvm_mem": 1,
}

# Log severities.
ERROR_SEVERITIES = ("error", "critical", "fatal")
WARN_SEVERITY = "warn"
DEFAULT_SEVERITY = "info"
SEVERITY_WEIGHTS = {"error": 3, "critical": 3, "fatal": 3, "warn": 2}

# Words that mark a failed call, and the service that receives unresolved root spans.
FAILED_CALL_WORDS = ("error", "fail", "exception")
ENTRY_SERVICE = "frontend"

# Infrastructure words, in order; word i stands for service slot i mod N.
INFRA_WORDS = ("mysql", "redis", "tomcat", "apache", "mg", "docker", "java", "node")

# Fault type by words in the top-ranked service's name, first match wins.
ROLE_FAULTS = (
    (("frontend", "gateway"), "cpu_contention"),
    (("payment", "checkout"), "network_delay"),
    (("cart", "catalog", "product"), "cpu_contention"),
    (("db", "mysql", "redis"), "high_memory"),
    (("shipping", "email"), "exception"),
)
DEFAULT_ROLE_FAULT = "cpu_contention"

# Fault type by the most deviant feature.
DIMENSION_FAULTS = {
    0: "high_cpu",
    1: "high_memory",
    2: "network_delay",
    3: "network_delay",
    4: "disk_io",
}
UNKNOWN_FAULT = "unknown"

# Column alternatives of service-level metric files, and defaults when none exists.
WORKLOAD_COLUMNS = (("rr", "num", "cnt"), 0.0)
SUCCESS_COLUMNS = (("sr", "succee_rate", "success_rate"), 100.0)
LATENCY_COLUMNS = (("mrt", "avg_time", "latency"), 0.0)
SERVICE_COLUMNS = ("service", "tc", "serviceName")
TIME_COLUMNS = ("timestamp", "startTime", "time")
SERVICE_METRIC_FILES = ("metric_service.csv", "metric_app.csv")
P99_FROM_LATENCY = 1.5

# Evidence weights (residual, timing, topology, drift).
EVIDENCE_WEIGHTS = {"r": 0.40, "t": 0.15, "p": 0.15, "d": 0.30}

# Window sizes, strides, thresholds and durations.
WINDOW = 24
TRAIN_STRIDE = 6
SCORE_STRIDE = 12
MIN_WINDOW_STEPS = 4
MIN_SCORED_STEPS = 5
FAULT_SECONDS = 600
STD_FLOOR = 1e-6
SIGMA_FLOOR = 1e-4
LOG_SIGMA_RANGE = (-5.0, 5.0)
NEVER = 9999
SUSTAIN = 3
LOOKBACK = 20
TAIL = 5
HOP_DELAY = 5
HOP_DECAY = 0.7
LEAK_SLOPE = 0.2
EDGE_WEIGHT = 0.3
KL_WEIGHT = 0.1
FREE_BITS = 1.0
FEATURE_COUNT = 8
