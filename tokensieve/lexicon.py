"""Vietnamese lexicons and the constants of the scores."""

from __future__ import annotations

import unicodedata

# Word lists, tables and constants that results depend on.

#: Tone names by id.
TONES: tuple[str, ...] = ("ngang", "huyền", "sắc", "hỏi", "ngã", "nặng")

#: Combining mark of each tone but the first.
TONE_MARKS: dict[str, str] = {"huyền": "\u0300", "sắc": "\u0301", "hỏi": "\u0309", "ngã": "\u0303", "nặng": "\u0323"}

#: How distinct two tones are, in tenths; symmetric, zero on the diagonal.
TONE_CONTRAST: dict[tuple[str, str], int] = {
    ("ngang", "huyền"): 5,
    ("ngang", "sắc"): 7,
    ("ngang", "hỏi"): 8,
    ("ngang", "ngã"): 9,
    ("ngang", "nặng"): 6,
    ("huyền", "sắc"): 9,
    ("huyền", "hỏi"): 6,
    ("huyền", "ngã"): 8,
    ("huyền", "nặng"): 4,
    ("sắc", "hỏi"): 7,
    ("sắc", "ngã"): 4,
    ("sắc", "nặng"): 8,
    ("hỏi", "ngã"): 7,
    ("hỏi", "nặng"): 8,
    ("ngã", "nặng"): 9,
}

#: Weights of density, variety and contrast, and the neighbourhood of the contrast.
TONE_ALPHA, TONE_BETA, TONE_GAMMA, TONE_WINDOW = 0.5, 0.3, 0.4, 2

#: Word classes with the share of each that is kept and its score multiplier.
CLASS_KEEP: dict[str, float] = {"function": 0.3, "content": 0.85, "reduplicative": 0.5, "compound": 0.95, "other": 0.5}
CLASS_MULTIPLIER: dict[str, float] = {"function": 0.4, "content": 1.2, "reduplicative": 0.6, "compound": 1.5, "other": 1.0}

#: Multipliers of the enhanced word classes.
ENHANCED_MULTIPLIER: dict[str, float] = {"CRITICAL": 3.0, "FUNC": 0.4, "SINO": 1.5, "CONTENT": 1.2, "REDUP": 0.6, "COMPOUND": 1.5, "OTHER": 1.0}

FUNCTION_WORDS: tuple[str, ...] = (
    "đã", "sẽ", "đang", "vừa", "mới", "từng", "bị", "được", "phải", "cần", "nên", "có_thể", "của", "cho",
    "với", "về", "tại", "trong", "ngoài", "trên", "dưới", "ở", "đến", "từ", "để", "bằng", "vào", "ra", "lên",
    "xuống", "và", "hoặc", "nhưng", "mà", "nếu", "thì", "vì", "tuy", "dù", "còn", "hay", "rằng", "là",
    "những", "các", "mọi", "mỗi", "một", "vài", "mấy", "cả", "tất_cả", "toàn_bộ", "cái", "con", "chiếc",
    "người", "cuốn", "quyển", "tờ", "bức", "tôi", "ta", "chúng_tôi", "chúng_ta", "mình", "họ", "nó", "này",
    "đó", "kia", "ấy", "đây", "nọ", "ạ", "nhé", "nhỉ", "đi", "thôi", "chứ", "cơ", "ư", "hả", "hử", "sao",
    "không", "chưa", "đừng", "chớ", "rất", "quá", "lắm", "hơi", "khá", "cực", "cực_kỳ", "luôn", "cũng", "vẫn",
    "cứ", "chỉ", "đều", "có", "làm", "khi", "khiến", "bắt_đầu", "tiếp_tục",
)

#: Reduplicative pairs: first and second word.
REDUPLICATIVE_PAIRS: tuple[tuple[str, str], ...] = (
    ("xinh", "xắn"), ("đẹp", "đẽ"), ("mạnh", "mẽ"), ("nhẹ", "nhàng"), ("vội", "vàng"), ("chậm", "chạp"),
    ("sạch", "sẽ"), ("dơ", "dáy"), ("sáng", "sủa"), ("tối", "tăm"), ("khó", "khăn"), ("dễ", "dàng"), ("ngoan",
    "ngoãn"), ("hư", "hỏng"), ("buồn", "bã"), ("vui", "vẻ"), ("lạnh", "lẽo"), ("nóng", "nực"), ("mát", "mẻ"),
    ("ấm", "áp"), ("rộng", "rãi"), ("hẹp", "hòi"), ("cao", "cả"), ("thấp", "thoải"), ("xa", "xôi"), ("gần",
    "gũi"), ("bừa", "bãi"), ("lộn", "xộn"), ("ngăn", "nắp"), ("chăm", "chỉ"), ("siêng", "năng"), ("lười",
    "nhác"), ("thông", "thái"), ("ngu", "ngốc"), ("khôn", "khéo"), ("vụng", "về"), ("tài", "tình"), ("giỏi",
    "giang"), ("lung", "linh"), ("long", "lanh"), ("lấp", "lánh"), ("rực", "rỡ"), ("lung", "lay"), ("đủng",
    "đỉnh"), ("thong", "thả"), ("từ", "tốn"), ("điềm", "đạm"), ("xanh", "xao"), ("vàng", "vọt"), ("đỏ",
    "đắn"), ("tim", "tím"), ("trắng", "trẻo"), ("đen", "đúa"),
)

COMPOUND_WORDS: tuple[str, ...] = (
    "hợp_tác_xã", "máy_tính", "điện_thoại", "học_sinh", "giáo_viên", "sinh_viên", "nhà_trường", "bệnh_viện",
    "sân_bay", "nhà_ga", "xe_buýt", "tàu_hỏa", "máy_bay", "ô_tô", "xe_máy", "xe_đạp", "công_ty",
    "doanh_nghiệp", "cửa_hàng", "siêu_thị", "ngân_hàng", "bưu_điện", "thư_viện", "nhà_sách", "công_viên",
    "bảo_tàng", "rạp_chiếu_phim", "nhà_hát", "đất_nước", "con_người", "xã_hội", "cộng_đồng", "môi_trường",
    "kinh_tế", "chính_trị", "văn_hóa", "giáo_dục", "y_tế", "khoa_học", "công_nghệ", "phát_triển", "bảo_vệ",
    "xây_dựng", "quản_lý", "nghiên_cứu", "đào_tạo", "sản_xuất", "kinh_doanh", "dịch_vụ", "thương_mại",
    "xuất_khẩu", "nhập_khẩu", "đầu_tư", "tài_chính", "kế_toán", "kiểm_toán", "luật_sư", "bác_sĩ", "kỹ_sư",
    "kiến_trúc_sư", "nhà_báo", "ca_sĩ", "diễn_viên", "vận_động_viên", "bóng_đá", "cầu_lông", "bơi_lội",
    "điền_kinh", "âm_nhạc", "hội_họa", "điện_ảnh", "nhiếp_ảnh", "hợp_tác_xã_nông_nghiệp", "ủy_ban_nhân_dân",
    "hội_đồng_nhân_dân", "tòa_án_nhân_dân", "viện_kiểm_sát_nhân_dân", "mặt_trận_tổ_quốc", "xinh_xắn",
    "đẹp_đẽ", "mạnh_mẽ", "nhẹ_nhàng", "vội_vàng", "chậm_chạp", "sạch_sẽ", "dơ_dáy", "sáng_sủa", "tối_tăm",
    "khó_khăn", "dễ_dàng", "ngoan_ngoãn", "hư_hỏng", "buồn_bã", "vui_vẻ",
)

COMMON_WORDS: tuple[str, ...] = (
    "tôi", "anh", "chị", "em", "mình", "họ", "nó", "ta", "chúng_tôi", "chúng_ta", "các_bạn", "mọi_người",
    "có", "không", "chưa", "đã", "sẽ", "đang", "vừa", "mới", "là", "thì", "nên", "vì", "tại", "bởi", "cho",
    "để", "với", "về", "đến", "từ", "ở", "trong", "ngoài", "trên", "dưới", "trước", "sau", "giữa", "bên",
    "này", "đó", "kia", "đây", "ấy", "nọ", "đâu", "rất", "quá", "lắm", "hơi", "khá", "cực", "cực_kỳ",
)

TEENCODE: dict[str, str] = {
    "ko": "không", "k": "không", "kh": "không", "hong": "không", "hông": "không", "hổng": "không", "chẳng":
    "không", "chả": "không", "dc": "được", "đc": "được", "đk": "được", "dx": "được", "ok": "được", "oke":
    "được", "ng": "người", "ngta": "người_ta", "ah": "anh", "e": "em", "a": "anh", "c": "chị", "m": "mày",
    "t": "tao", "bn": "bạn", "mn": "mọi_người", "ae": "anh_em", "ace": "anh_chị_em", "vs": "với", "w": "với",
    "cx": "cũng", "cxn": "cũng", "cug": "cũng", "vc": "vợ_chồng", "ck": "chồng", "vk": "vợ", "ny":
    "người_yêu", "bb": "bạn_bè", "nc": "nói_chuyện", "nt": "nhắn_tin", "ib": "nhắn_tin", "inb": "nhắn_tin",
    "cmt": "bình_luận", "cm": "bình_luận", "rep": "trả_lời", "fb": "facebook", "h": "giờ", "p": "phút", "s":
    "sao", "tn": "tuần", "th": "tháng", "n": "năm", "tk": "tài_khoản", "sp": "sản_phẩm", "đt": "điện_thoại",
    "dt": "điện_thoại", "mt": "máy_tính", "lh": "liên_hệ", "stt": "số_thứ_tự", "st": "số_thứ_tự", "cl":
    "chất_lượng", "sl": "số_lượng", "bh": "bảo_hành", "km": "khuyến_mãi", "vui": "vui", "bùn": "buồn", "giận":
    "giận", "thưn": "thương", "thik": "thích", "thix": "thích", "ghét": "ghét", "ghen": "ghen", "nhớ": "nhớ",
    "bt": "biết", "bít": "biết", "hiu": "hiểu", "nghĩ": "nghĩ", "nghix": "nghĩ", "nghj": "nghĩ", "lm": "làm",
    "lam": "làm", "lèm": "làm", "j": "gì", "chi": "gì", "z": "vậy", "zị": "vậy", "sao": "sao", "seo": "sao",
    "nhìu": "nhiều", "nhiu": "nhiều", "ít": "ít", "hơi": "hơi", "khá": "khá", "cực": "rất", "quá": "quá",
    "lắm": "lắm", "siêu": "rất", "cực_kỳ": "rất",
}

DIALECT_CENTRAL: dict[str, str] = {
    "mô": "nào", "tê": "kia", "răng": "sao", "rứa": "thế", "chi": "gì", "nờ": "nào", "chừ": "giờ", "mi":
    "mày", "tau": "tao", "hắn": "nó", "bọn_hắn": "bọn_nó", "eng": "em", "nác": "nước", "đọi": "bát", "trốc":
    "đầu", "tru": "trâu", "cươi": "sân", "nốc": "uống", "bổ": "ngã", "trốc_tru": "ngu_ngốc",
}

DIALECT_SOUTHERN: dict[str, str] = {
    "hông": "không", "hổng": "không", "hen": "nhé", "ghe": "thuyền", "mắc": "đắt", "bông": "hoa", "trái":
    "quả", "thơm": "dứa", "đậu_phộng": "lạc", "má": "mẹ", "tía": "bố", "ngoại": "bà_ngoại", "nội":
    "ông_bà_nội", "cưng": "yêu", "ghê": "nhiều", "dữ": "nhiều", "dễ_sợ": "nhiều", "dữ_thần": "nhiều", "chén":
    "ăn", "nhậu": "ăn_nhậu", "dzô": "uống", "xe_hơi": "ô_tô", "vi_tính": "máy_tính", "quần_gin": "quần_bò",
    "áo_thun": "áo_phông", "chả_lụ": "chả_lụa", "bánh_mì": "bánh_mì", "nước_đá": "đá", "đá_lạnh": "đá",
}

DIALECT_NORTHERN: dict[str, str] = {
    "ngô": "bắp", "dứa": "thơm", "lợn": "heo", "quả": "trái", "hoa_quả": "trái_cây", "bát": "chén", "đũa":
    "đũa", "thìa": "muỗng", "muôi": "vá", "rổ": "rổ", "rá": "rá", "chăn": "mền", "gối": "gối", "đệm": "nệm",
    "phích": "bình_thủy", "ấm": "ấm", "tích": "bình_trà",
}

SINO_MORPHEMES: tuple[str, ...] = (
    "quốc", "gia", "xã", "hội", "chính", "phủ", "học", "sinh", "giáo", "viên", "công", "nghiệp", "thương",
    "mại", "nông", "lâm", "ngư", "khoa", "kỹ", "thuật", "văn", "hóa", "nghệ", "mỹ", "y", "tế", "dược", "luật",
    "pháp", "kinh", "tài", "điện", "tử", "cơ", "khí", "kiến", "trúc", "xây", "dựng", "phát", "triển", "bảo",
    "vệ", "quản", "lý", "nghiên", "cứu", "đào", "tạo", "sản", "xuất", "doanh", "đầu", "tư", "thông", "tin",
    "truyền", "viễn", "giao", "vận", "tải", "hàng", "không", "hải", "đường", "thủy", "lợi", "thanh", "tra",
    "kiểm", "soát", "thẩm", "định", "tổ", "chức", "đoàn", "thể", "hợp", "tác", "liên", "kết", "thống", "nhất",
    "độc", "lập", "tự", "do", "dân", "chủ", "cộng", "đồng", "hòa", "bình",
)

# End of the fixed values; what follows is built from them.

DIALECT: dict[str, str] = DIALECT_CENTRAL | DIALECT_SOUTHERN | DIALECT_NORTHERN

#: Words that the greedy segmenter joins, up to MAX_PARTS parts.
WORD_LIST: frozenset[str] = frozenset(COMPOUND_WORDS) | frozenset(COMMON_WORDS)
MAX_PARTS = 5

#: The second word of a pair, and the pair as one word.
REDUPLICATIVE_KEYS: frozenset[str] = frozenset(k for a, b in REDUPLICATIVE_PAIRS for k in (b, f"{a}_{b}"))


def _toned_characters() -> dict[str, int]:
    """Tone id of every vowel that can bear a tone, in both cases, composed (NFC) only."""
    vowels = [unicodedata.normalize("NFC", v) for v in ("a", "a\u0306", "a\u0302", "e", "e\u0302", "i", "o", "o\u0302", "o\u031b", "u", "u\u031b", "y")]
    out = {}
    for v in vowels + [v.upper() for v in vowels]:
        out[v] = 0
        for name, mark in TONE_MARKS.items():
            out[unicodedata.normalize("NFC", v + mark)] = TONES.index(name)
    return out


CHAR_TONE: dict[str, int] = _toned_characters()
#: The characters that bear a tone, and the digit of each one's tone.
TONED: str = "".join(c for c, t in CHAR_TONE.items() if t)
TONED_DIGITS: str = "".join(str(t) for t in CHAR_TONE.values() if t)


def _contrast_matrix() -> list[int]:
    """TONE_CONTRAST as a row-major 6 by 6 array of tenths."""
    flat = [0] * 36
    for (a, b), v in TONE_CONTRAST.items():
        i, j = TONES.index(a), TONES.index(b)
        flat[6 * i + j] = flat[6 * j + i] = v
    return flat


CONTRAST_FLAT: list[int] = _contrast_matrix()


def _strip_table() -> tuple[str, str]:
    """Composed characters that bear a tone mark in their canonical decomposition, and what is left of each."""
    marks, source, target = set(TONE_MARKS.values()), [], []
    for code in range(0x110000):
        c = chr(code)
        full = unicodedata.normalize("NFD", c)
        if len(full) > 1 and marks & set(full):
            bare = unicodedata.normalize("NFC", "".join(x for x in full if x not in marks))
            if len(bare) == 1:
                source.append(c)
                target.append(bare)
    return "".join(source), "".join(target)


STRIP_FROM, STRIP_TO = _strip_table()
STRIP_DELETE: str = "".join(TONE_MARKS.values())


def sino_compounds() -> list[str]:
    """Ordered pairs of different morphemes, joined by ``_``, of at least six characters."""
    return [f"{a}_{b}" for a in SINO_MORPHEMES for b in SINO_MORPHEMES if a != b and len(a) + len(b) + 1 >= 6]
