"""Parameters and fixed values.

FIXED VALUES: the strings, labels and limits below must equal those of the
original corpus tool for results to match; they are stated here in their
natural order.
"""

# --- FIXED VALUES: sizes and thresholds -------------------------------------
WINDOW = 256            # sliding window size (characters)
OVERLAP = 80            # window overlap (characters)
MIN_PART = 30           # parts shorter than this are glued to the previous one
FULL_MAX = 512          # full chunk cap; longer ones keep 509 chars + "..."
QUERY_REF_MAX = 120     # query_ref / source prefix length
TOP_K = 5
FLOOR = 0.45            # relevance floor, applied after the top-k cut
GATE = 0.78             # below this best score (or < 2 hits) the question goes to the web
MIN_HITS = 2
CONTEXT_MAX = 1500
SESSION_MEMORY = 20
TITLE_MAX = 28
HASH_DIM = 64           # size of the default hashed embedding
VOCAB_SIZE = 32000
MIN_FREQUENCY = 2
MAX_SEQ_LEN = 1024
EVAL_FRACTION = 0.2
SPLIT_SEED = 42
INDEX_BATCH = 256
TRAIN_BATCH = 2
PAD_MULTIPLE = 8
LABEL_PAD = -100

# --- FIXED VALUES: chunk prefixes ---------------------------------------------
QUESTION_PREFIX = "[ĐỀ BÀI] "
SOLUTION_PREFIX = "[LỜI GIẢI - bước "      # followed by "i/N] "
FULL_PREFIX = "[FULL] "
FULL_SEPARATOR = " | "
ELLIPSIS = "..."
TITLE_ELLIPSIS = "…"

# --- FIXED VALUES: step markers (a new step starts before each of these) ------
STEP_MARKERS = [
    r"Bước\s*\d",
    r"\n\s*\d+[\.\)]\s",
    r"\nVậy\s",
    r"\nDo đó\s",
    r"\nTa có\s",
    r"\nGiải:",
    r"\nThay\s",
]
# sentence ends that may close a window
SENTENCE_ENDS = [". ", ".\n", "! ", "? "]

# --- FIXED VALUES: chat template ------------------------------------------------
SYSTEM_PROMPT_VI = (
    "Bạn là một trợ lý toán học."
    "Hãy giải bài toán chi tiết và rõ ràng bằng tiếng Việt."
)
SYSTEM_PROMPT_EN = (
    "You are an expert in Mathematics."
    "Solve this problem clearly."
)
TEMPLATE_REQUIRED = ["[SYS]", "[/SYS]", "[USR]", "[/USR]", "[AST]"]

# --- FIXED VALUES: special tokens, in vocabulary order ---------------------------
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[BOS]", "[EOS]", "[MASK]",
                  "[SYS]", "[USR]", "[AST]", "[/SYS]", "[/USR]", "[/AST]"]
PAD_TOKEN, UNK_TOKEN, BOS_TOKEN, EOS_TOKEN = "[PAD]", "[UNK]", "[BOS]", "[EOS]"

# --- FIXED VALUES: retrieval context ------------------------------------------------
TYPE_RANK = {"question": 0, "solution": 1, "full": 2}
UNKNOWN_TYPE_RANK = 3
MISSING_TYPE_RANK = 2          # a hit without chunk_type sorts as "full"
TYPE_LABEL = {
    "question": "Bài toán tương tự",
    "solution": "Lời giải tham khảo",
    "full": "Bài toán hoàn chỉnh",
}
DEFAULT_LABEL = "Tham khảo"
CONTEXT_SEPARATOR = "\n\n---\n\n"
CONTEXT_HEADER = "### Ngữ cảnh từ dữ liệu:\n"
WEB_HINT_HEADER = "### Gợi ý từ internet:\n"
QUESTION_HEADER = "Câu hỏi: "
WEB_QUERY_PREFIX = "Toán học: Cách giải "
WEB_SUMMARY_PROBLEM = "Bài toán: "
WEB_SUMMARY_RESULTS = "\n\nKết quả tìm kiếm từ Internet:\n"
WEB_SUMMARY_ASK = "\n\nHãy tóm tắt thông tin hữu ích để giải bài toán trên."
RAG_SYSTEM_PROMPT = (
    "Bạn là trợ lý toán học thông minh. "
    "Hãy giải các bài toán chính xác, trình bày từng bước rõ ràng bằng tiếng Việt. "
    "Chỉ dùng thông tin từ ngữ cảnh được cung cấp và kiến thức toán học của bạn."
    "Khi gặp các bài toán có chứa các con số lớn (như hàng trăm nghìn, hàng triệu), hãy chủ động quy đổi đơn vị (ví dụ: chuyển sang đơn vị 'nghìn đồng', 'triệu đồng') để đơn giản hóa biểu thức số học trước khi thực hiện lấy đạo hàm hoặc giải phương trình. Hãy kiểm tra lại các bước nhân chia trước khi đưa ra đáp số cuối cùng."
)
WEB_SYSTEM_PROMPT = (
    "Bạn là chuyên gia toán học. "
    "Với bài toán được đưa ra và kết quả tìm kiếm từ internet, hãy: "
    "1) Xác định dạng toán và công thức liên quan. "
    "2) Tóm tắt các thông tin hữu ích từ kết quả tìm kiếm. "
    "3) Gợi ý hướng giải ngắn gọn. "
    "Trả lời bằng tiếng Việt, KHÔNG giải hoàn chỉnh — chỉ cung cấp context."
)
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "

# --- FIXED VALUES: math delimiters, tried in this order -------------------------------
MATH_DELIMITERS = [("$$", "$$"), ("$", "$"), ("\\[", "\\]"), ("\\(", "\\)")]
