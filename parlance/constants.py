"""Fixed values that must equal the reference's for identical results.

Stated plainly, in their natural order. Everything else in the package is
parameterised.
"""

# --- fixed values: request bounds and defaults (inclusive bounds) ---
MAX_TOKENS_MIN = 128
MAX_TOKENS_MAX = 2048
TEMPERATURE_MIN = 0.01
TEMPERATURE_MAX = 1.0
TOP_P_MIN = 0.01
TOP_P_MAX = 10.0

DEFAULT_MAX_TOKENS = 256
DEFAULT_TEMPERATURE = 0.8
DEFAULT_TOP_P = 0.95

# --- fixed values: display and timing limits ---
ID_LENGTH = 12
PROMPT_IN_TRUNCATION_LENGTH = 256
MESSAGE_MAX_LENGTH = 2000
EMBED_MAX_LENGTH = 1024
ACTION_TIMEOUT_SECONDS = 120
RELOAD_LAST_MINUTES = 120
MAX_ATTEMPTS = 5
MAX_TOKEN_WINDOW = 2048
MIN_GENERATION_LENGTH = 10

# --- fixed values: instruction template strings ---
EXTRA_MYSTERY_LINE = ("<s> Below is an instruction that describes a task. Write a response that "
                      "appropriately completes the request.\n\n")
PREFIX_NO_INPUT = ("Below is an instruction that describes a task. Write a response that "
                   "appropriately completes the request.\n\n")
PREFIX_INPUT = ("Below is an instruction that describes a task, paired with an input that provides "
                "further context. Write a response that appropriately completes the request.\n\n")
INSTRUCT = "### Instruction:\n"
INPUT = "\n### Input:\n"
ANSWER = "\n### Response:\n"
INPUT_MARKER = "### Input:"

# --- fixed values: messages ---
FALLBACK_ANSWER = "Sorry, I don't know how to answer this prompt."
OUTPUT_TITLE = "Output"
CONTINUED_TITLE = "Continued Output"
LINK_BASE = "https://discord.com/channels"

# --- fixed values: short id alphabet (lowercase, uppercase, digits) ---
ID_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

# --- fixed values: moderation score thresholds (flag when strictly above) ---
THRESHOLDS = {
    "sexual_explicit": 0.1,
    "obscene": 0.5,
    "toxicity": 0.8,
    "severe_toxicity": 0.5,
    "identity_attack": 0.5,
}

# --- fixed values: generation stop words (as text tokens) and end marker ---
STOP_WORDS = ["<unk>", "<s>", "</s>", "�", "!0"]
END_MARKER = "</s>"

# --- fixed values: quantization search grid ---
MSE_NORM = 2.4
MSE_GRID = 100
MSE_MAXSHRINK = 0.8
GPTQ_BLOCKSIZE = 128
GPTQ_PERCDAMP = 0.01
LABEL_IGNORE = -100
