"""The patterns, phrases and word lists that define the results of the operators.

Patterns are written for Java (Spark). ``(?U)`` gives \\b, \\w and \\s their Unicode meaning; ``(?d)`` ends lines at \\n alone.
"""

SECTION = r"^((?:\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*))\s+(.+)$"
SECTION_DOTTED = r"^((?:\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*))\.?\s+(.+)$"
VALID_SECTION = r"^(?:[A-C]\d+(?:\.\d+)*)$"
TABLE_CAPTION = r"(?i)^Table\s+[A-Za-z]?\d+(?:[-.]\d+)*[:.]?\s*.*$"
FIGURE_CAPTION = r"(?i)^Figure\s+[A-Za-z]?\d+(?:[.\-]\d+)*\s*[:.]\s"
REQUIREMENT_ID = r"(?i)([A-Z_]*REQ[-_]?\d+)"
NOTE = r"(?i)^(NOTE|WARNING|CAUTION|IMPORTANT|ASSUMPTION)\b"
ACRONYM = r"\b([A-Z]{2,10})\b"
SIGNAL = r"\b[A-Z][A-Z0-9_]{2,}\b"
SECTION_REF = r"(?i)Section\s+\d+(?:\.\d+)*"
FIGURE_REF = r"(?i)Figure\s+[A-Za-z]?\d+(?:[-.]\d+)*"
TABLE_REF = r"(?i)Table\s+[A-Za-z]?\d+(?:[-.]\d+)*"
NUMBER = r"(?i)[-+]?\d+(?:\.\d+)?(?:\s*(?:%|v|a|hz|khz|mhz|ghz|ms|us|ns|s|kb|mb|gb|bit|bits|byte|bytes))?"
REFERENCE = r"(?i)\b(?:section|figure|fig\.?|table)\s+[A-Za-z]?\d+(?:[-.]\d+)*"
STRENGTH = r"(?i)\b(shall|must|will|should|required to|may not|is prohibited|may|can)\b"
CROSS_REFERENCE = r"(?i)^(Section|Table|Figure)\s+([A-Za-z]?\d+(?:[-.]\d+)*)$"
TABLE_NUMBER = r"(?i)^(?:Table)\s+([A-Za-z]?\d+(?:[-.]\d+)*)"
AXI_SIGNAL = r"(?i)\b[AR][RW](?:VALID|READY|LEN|SIZE|BURST|ID|ADDR|LOCK|CACHE|PROT|QOS|REGION)\b|\b[RWB](?:VALID|READY|DATA|LAST|STRB|RESP|ID)\b"
RISCV_CSR = (
    r"(?i)\b(?:mstatus|mtvec|mepc|mcause|mtval|mie|mip|mscratch|mideleg|medeleg|satp|sstatus|stvec|sepc|scause|stval|sie|sip|sscratch|"
    r"pmpcfg\d*|pmpaddr\d*|misa|mhartid|RV(?:32|64|128)[IEMAFDQC]*)\b"
)
TECHNICAL_TOKEN = (
    r"\b(0[xX][0-9A-Fa-f]+|RV(?:32|64|128)[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)+"
    r"|[a-z][a-z0-9]{2,}(?:status|cause|tval|tvec|epc|scratch|ie|ip|atp|cfg\d*|addr\d*))\b"
)

#: Fixed value: a row of an encoding table in running text (code, operation, meaning).
ENCODING_RULE = (
    r"(?s)(0b[01]+)\s+"
    r"([A-Za-z][A-Za-z0-9_-]*)\s+"
    r"(.*?)"
    r"(?=\s+0b[01]+\s+[A-Za-z][A-Za-z0-9_-]*\s+"
    r"|\s+(?:\d+(?:\.\d+)*|[A-C]\d+(?:\.\d+)*)\s+"
    r"|\s+[A-C]\d+(?:\.\d+)+\s+[A-Za-z]"
    r"|\s+Table\s+[A-Za-z]?\d+(?:\.\d+)*"
    r"|\s+ARM IHI"
    r"|\n?\z)"
)

FIGURE_MENTION = r"(?i)\b(?:Figure|Fig\.?)\s+[A-Za-z]?\d+(?:\.\d+)*"
LEAD_IN = r"(?iU)^(?:In Figure|As shown in Figure|The figure shows|This assertion indicates|In this case|For example)\b"

REQUIREMENT_PHRASES = [
    "shall", "must", "must not", "will", "should", "required to", "may not", "is prohibited", "remains asserted",
    "remain asserted", "indicates that", "can be sent", "must be ordered", "can only be", "is returned", "is issued",
    "is generated", "is valid only when",
]

SPECIFICATION_PHRASES = [
    "shall not", "shall", "must not", "must", "should not", "should", "cannot", "can not", "may not",
    "must have", "must not have", "must be", "must not be", "must issue", "must not issue", "must complete",
    "must not complete", "must be consistent", "must not cross", "must be able to", "must be given",
    "is required to", "are required to", "required to", "requires that",
    "is prohibited", "are prohibited", "prohibited to",
    "is not allowed to", "are not allowed to", "not allowed to", "is allowed to", "are allowed to", "allowed to",
    "is not permitted to", "are not permitted to", "not permitted to", "is permitted to", "are permitted to", "permitted to",
    "must remain", "shall remain", "must be held", "must be stable", "shall be stable", "remain stable",
    "shall be asserted", "must be asserted", "shall be deasserted", "must be deasserted",
    "is valid only when", "are valid only when", "is only valid", "are only valid", "occurs only when", "is not valid",
    "are not valid", "can only be", "may only be", "is not supported", "are not supported", "is optional", "are optional",
    "length can be", "can discard", "can omit", "can be lower than", "can be higher than", "can be up to", "may be up to",
    "can range from", "may range from", "can be asserted", "can be deasserted", "may be asserted", "may be deasserted", "can be sent",
]

ACRONYM_STOPLIST = [
    "THE", "AND", "FOR", "WITH", "FROM", "THIS", "THAT", "ARE", "NOT", "BUT", "ITS", "ALL", "ANY", "CAN",
    "HAS", "HAVE", "BEEN", "WILL", "MAY", "SHALL", "MUST", "WHEN", "THEN", "EACH", "SUCH", "BOTH", "ALSO", "INTO",
    "OVER", "UPON", "USED", "ONLY", "MORE", "THAN", "WHICH", "THERE", "THEIR", "THESE", "THOSE", "WHAT",
    "PAGE", "NOTE", "TYPE", "DATA", "BASE", "TRUE", "FALSE",
]

COMMON_TOKENS = [
    "the", "and", "for", "with", "that", "this", "from", "shall", "must", "should", "will", "may", "can", "are", "was",
    "were", "has", "have", "not", "when", "then", "than", "into", "only", "value", "values", "section", "figure", "table",
]

CATEGORIES = {
    "Performance": ["latency", "throughput", "timing", "frequency", "bandwidth", "clock rate", "cycles per", "ipc", "mhz", "ghz", "performance"],
    "Electrical": ["voltage", "current", "power", "vdd", "vcc", "vref", "amperage", "watt", "dissipation", "impedance"],
    "Environmental": ["temperature", "humidity", "thermal", "esd", "altitude", "vibration"],
    "Safety": ["safety", "hazard", "fault", "asil", "functional safety", "redundant", "ecc", "parity", "error correction", "watchdog"],
    "Security": ["encryption", "authentication", "secure boot", "pmp", "tee", "cryptograph", "attestation", "tamper"],
    "Protocol": [
        "axi", "amba", "ahb", "apb", "ace", "chi", "tilelink", "burst", "handshake", "arvalid", "awvalid", "wready", "bvalid",
        "arbiter", "master", "slave", "manager", "subordinate", "outstanding transaction", "beat", "strobe",
    ],
    "Memory": [
        "cache", "tlb", "mmu", "dram", "sram", "memory-mapped", "memory map", "address space", "page table", "coherenc",
        "physical address", "virtual address",
    ],
    "Architecture": [
        "instruction", "opcode", "register", "risc-v", "riscv", "isa", "extension", "privilege mode", "csr", "trap", "exception",
        "interrupt", "pipeline", "hart", "atomic", "vector unit",
    ],
    "Interface": ["interface", "pin", "signal", "spi", "uart", "i2c", "can", "gpio", "jtag", "pcie"],
}
#: The shorter lists of the third generation.
SHORT_CATEGORIES = {
    "Performance": ["latency", "throughput", "timing", "frequency", "bandwidth"],
    "Electrical": ["voltage", "current", "power"],
    "Environmental": ["temperature", "humidity"],
    "Safety": ["safety", "hazard", "fault"],
    "Interface": ["interface", "spi", "uart", "i2c", "can"],
}
DEFAULT_CATEGORY = "Functional"
PRIORITY = ["Protocol", "Architecture", "Memory", "Security", "Safety", "Electrical", "Performance", "Environmental", "Interface"]

VISUAL_HINTS = ["valid", "ready", "reset", "aresetn", "aclk", "handshake", "transfer", "asserted", "deasserted", "stable", "high", "low", "write", "read", "response", "address", "data"]

REQUIRED_FIELDS = ["document_name", "metadata", "total_pages", "sections", "requirements", "figures", "tables", "notes", "acronyms", "cross_references", "semantic_chunks", "pages"]

#: Thresholds of similarity matching by area, and whether moved items are reported.
THRESHOLDS = {"requirement": 0.78, "note": 0.78, "figure": 0.70, "table": 0.65, "page": 0.30}
DEFAULT_THRESHOLD = 0.72
RELOCATED = {"requirement": False, "note": True, "figure": True, "table": True}
MAX_TOKENS = 40
MAX_CANDIDATES = 20
MIN_LENGTH_RATIO = 0.35
MIN_OVERLAP = 0.08
MINOR, SUBSTANTIVE = 0.90, 0.65


def phrases(words: list[str]) -> str:
    """A pattern for any of the phrases as whole words, whatever their case; the first that fits wins."""
    return r"(?iU)\b(" + "|".join(words) + r")\b"


REQUIREMENT = phrases(REQUIREMENT_PHRASES)
SPECIFICATION = phrases(SPECIFICATION_PHRASES)


def nearly(words: list[str]) -> str:
    """A pattern found wherever phrases(words) is found in the text with its white space squashed, and faster: of a phrase that holds
    another one the shorter does, and phrases are told apart by their first words."""
    least = [w for w in words if not any(v != w and f" {v} " in f" {w} " for v in words)]
    by_first: dict[str, list[str]] = {}
    for w in dict.fromkeys(least):
        first, _, rest = w.partition(" ")
        by_first.setdefault(first, []).append(rest.replace(" ", SPACES))
    branches = [first if rests == [""] else f"{first}{SPACES}(?:{'|'.join(rests)})" for first, rests in by_first.items()]
    return rf"(?iU)\b(?:{'|'.join(branches)})\b"


SPACES = r"[\s\x1c-\x1f]+"
SPECIFICATION_NEAR = nearly(SPECIFICATION_PHRASES)
