"""Words, patterns and names that results depend on, as the pattern language of Java writes them."""

from __future__ import annotations

#: Phrases that try to overwrite the instructions of a model.
INJECTION = (
    r"\bignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?)\b",
    r"\bdisregard\s+(all\s+|any\s+)?(previous|prior|above)\s+(instructions?|rules?)\b",
    r"\boverride\s+(the\s+)?(system\s+)?(prompt|instructions?|rules?)\b",
    r"\breveal\s+(your|the)\s+(system\s+prompt|instructions?)\b",
    r"\bnew\s+system\s+prompt\b",
    r"\byou\s+are\s+now\s+(a|an)\b",
    r"\bact\s+as\s+(if\s+you\s+(are|were)\s+)?(an?\s+)?(unrestricted|uncensored|jailbroken)\b",
    r"\bbỏ\s+qua\s+(mọi|tất cả|toàn bộ)\s+(hướng dẫn|chỉ dẫn|quy tắc|lệnh|prompt)\b",
    r"\bquên\s+(đi\s+)?(mọi|tất cả)?\s*(hướng dẫn|vai trò|quy tắc)\s+(trước đó|đã (được )?cho|ban đầu)\b",
    r"\bbỏ\s+vai\s+trò\s+(trợ lý|ai)\b",
    r"\bkhông\s+(cần|phải)\s+tuân\s+theo\s+(quy tắc|hướng dẫn|system prompt)\b",
    r"\btiết\s+lộ\s+(system\s+)?prompt\b",
    r"\bhệ\s+thống\s+prompt\s+mới\b",
    r"\bbạn\s+(bây giờ|giờ)\s+là\s+(một\s+)?(ai|trợ lý)\s+(mới|khác|không giới hạn)\b",
    r"\bin\s+developer\s+mode\b",
    r"\bchế\s+độ\s+(nhà\s+)?phát\s+triển\b",
)

#: Phrases that ask a model to play without rules.
JAILBREAK = (
    r"\bdo\s+anything\s+now\b",
    r"\bDAN\b(?=.{0,40}(jailbreak|do anything|no rules|unrestricted))",
    r"\bjailbreak(ed|ing)?\b",
    r"\bhypothetical(ly)?\b.{0,30}\b(no rules?|without (any )?restrictions?|unrestricted)\b",
    r"\bpretend\s+(that\s+)?you\s+(have\s+no|don't have any)\s+(rules|restrictions|filters)\b",
    r"\bkhông\s+bị\s+(giới hạn|ràng buộc)\s+(bởi\s+)?(quy tắc|đạo đức|chính sách|kiểm duyệt)\b",
    r"\bvượt\s+qua\s+(mọi\s+)?(giới hạn|kiểm duyệt|bộ lọc)\b",
    r"\bgiả\s+(vờ|sử)\s+(bạn\s+)?(không|ko)\s+có\s+(bất kỳ\s+)?(quy tắc|giới hạn|ràng buộc)\b",
    r"\btrả\s+lời\s+như\s+thể\s+(bạn\s+)?(không|ko)\s+có\s+(quy tắc|ràng buộc)\b",
)

#: Personal data, flagged and never blocked, in the order of the flags.
PERSONAL = (
    ("cccd_cmnd", r"\b\d{9}(?:\d{3})?\b"),
    ("phone", r"(?:\+84|0)(?:3[2-9]|5[689]|7[06-9]|8[1-9]|9[0-9])\d{7}\b"),
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
)

#: A cited article.
CITATION = r"Điều\s+\d+[a-zđ]?\b"

#: What replaces a redacted phrase.
REDACTED = "[NỘI DUNG ĐÃ BỊ LỌC — NGHI VẤN CHỨA CHỈ THỊ ẨN]"

#: Words that ask for a summary, refer back, or compare.
SUMMARY = ("tóm tắt", "tổng quan", "tổng hợp", "nội dung chính", "nói về cái gì", "nói về vấn đề gì", "tóm ý", "chủ đề chính", "summarize", "summary", "overview")
REFERENTIAL = ("nó", "họ", "chúng nó", "cái đó", "cái này", "như trên", "như vậy", "ở trên", "vừa nói", "vừa rồi", "trên đó", "đó", "này", "việc đó", "văn bản đó", "điều kiện đó", "khoản đó")
COMPARISON = ("so sánh", "khác nhau", "giống nhau", "so với", "khác gì")

#: Openings of an answer that refuses.
REFUSALS = ("tôi không tìm thấy thông tin", "không tìm thấy thông tin này")

#: Departments and their labels; the empty one is open to all.
DEPARTMENTS = {
    "ban_giam_doc": "Ban Giám đốc",
    "hr": "Phòng Nhân sự (HR)",
    "finance": "Phòng Tài chính - Kế toán",
    "sales": "Phòng Kinh doanh (Sales)",
    "marketing": "Phòng Marketing",
    "it": "Phòng Công nghệ thông tin (IT)",
    "rd": "Phòng Nghiên cứu và Phát triển (R&D)",
    "operations": "Phòng Vận hành / Sản xuất",
    "procurement": "Phòng Mua hàng & Chuỗi cung ứng",
    "legal": "Phòng Pháp chế & Tuân thủ (Legal)",
    "cs": "Phòng Chăm sóc khách hàng (CS)",
    "qa_qc": "Phòng Đảm bảo chất lượng (QA/QC)",
}

#: States and types of documents.
STATUSES = ("hieu_luc", "het_hieu_luc", "da_thay_the", "chua_xac_dinh")
TYPES = ("luat", "nghi_dinh", "thong_tu", "quyet_dinh", "")


def any_of(patterns) -> str:
    """One pattern for all, case-insensitive and of Unicode letters."""
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns).replace(r"\b", r"(?U:\b)").replace(r"\s", r"(?U:\s)").replace(r"\w", r"(?U:\w)").replace(r"\d", r"(?U:\d)")
