"""Fixed values of sections 7 and 8 and of the structure normaliser: labels, stop labels and markers. Data only."""

# What repeats on every page. Marks within a line, whole lines, the title and the address that frame a heading.
PAGE_MARKS = [r"---\s*PAGE\s+\d+\s*---", r"\bSayfa\s*(?:No\s*:?\s*)?\d+\s*/\s*\d+\b", r"\bPage\s+\d+\s*(?:of|/)\s*\d+\b"]
PAGE_TITLE = r"\b(?:GÜVENLİK\s+BİLGİ\s+FORMU|SAFETY\s+DATA\s+SHEET)\b"
PAGE_ADDRESS = r"(?:https?://|www\.)"
PAGE_LINES = [
    r"---\s*PAGE\s+\d+\s*---", r"Sayfa\s+(?:No\s*:\s*)?\d+\s*/\s*\d+", r"Page\s+\d+\s*(?:of|/)\s*\d+", r"GÜVENLİK\s+BİLGİ\s+FORMU", r"SAFETY\s+DATA\s+SHEET", r"Düzenleme\s+Sayısı\s*:.*", r"Düzenleme\s+No\.?\s*:.*",
    r"Revizyon\s+Numarası\s*:.*", r"Revision\s+(?:Number|No\.?)\s*:.*", r"Form\s+No\s*:.*", r"Hazırlama\s+Tarihi\s*:.*", r"Hazırlanma\s+Tarihi\s*:.*", r"Preparation\s+Date\s*:.*", r"Revision\s+Date\s*:.*",
    r"Revizyon\s+Tarihi\s*:.*", r"Yeniden\s+Düzenlenme\s+ve\s+Yayın\s+Tarihi\s*:.*", r"Yeniden\s+Düzenleme\s+ve\s+Yayın\s+Tarihi\s*:.*", r"(?:https?://|www\.)\S+.*",
]
#: A title and the address below it are a page's heading if they stand within so many lines.
PAGE_HEADING_LINES = 15
# Beginnings of lines that are no content of section 8, and of revision dates within its text.
NOISE_LINES = [
    r"---\s*PAGE\s+\d+\s*---$", r"PAGE\s+\d+", r"Sayfa\s+(?:No\s*:?\s*)?\d+\s*/?\s*\d*", r"Form\s+No", r"GÜVENLİK\s+BİLGİ\s+FORMU", r"SAFETY\s+DATA\s+SHEET", r"Hazırlama\s+Tarihi", r"Hazırlanma\s+Tarihi",
    r"Yeni\s+Düzenleme\s+Tarihi", r"Yeniden\s+Düzenleme", r"Yeniden\s+Düzenlenme", r"Kaçıncı\s+Düzenleme", r"Düzenleme\s+Sayısı", r"Revizyon\s+Numarası", r"Revision\s+Date", r"Preparation\s+Date", "https?://", r"www\.",
]
NAMED_DAY = r"\d{1,2}\s*[-./]\s*[A-Za-zÇĞİÖŞÜçğıöşü]+\s*[-./]\s*\d{4}"
REVISION_NOISE = [rf"\bRevizyon\s+tarihi\s+{NAMED_DAY}", rf"\bRevision\s+date\s*:?\s*{NAMED_DAY}"]
# What shows that a value of section 8 holds a page's heading.
HEADING_MARKERS = ["güvenlik bilgi formu", "safety data sheet", "sayfa no:", "page no:", "düzenleme sayısı", "hazırlama tarihi", "yeniden düzenlenme ve yayın tarihi", "form no:", "www."]

# Labels of section 7.
HANDLING = ["Güvenli elleçleme için tavsiye", "Elleçleme için tavsiye", "Güvenli kullanım için tavsiye", "Güvenli Elleçleme İçin Uyarılar", "Advice on safe handling", "Precautions for safe handling", "Safe handling advice"]
HANDLING_HEADINGS = ["Güvenli elleçleme için önlemler", "Precautions for safe handling"]
HANDLING_HYGIENE = ["Genel hijyen hususları", "Genel hijyen önlemleri", "Genel Mesleki Hijyen İle İlgili Tavsiyeler", "Hijyen önlemleri", "General hygiene considerations", "Hygiene measures"]
FIRE = [
    "Yangın ve patlamadan korunmak için uyarılar", "Yangın ve patlamadan korunma için uyarılar", "Yangın ve patlamadan korunma", "Yangın ve patlama önlemleri",
    "Yangın ve patlama tehlikelerine karşı önlemler", "Information about fire - and explosion protection", "Advice on protection against fire and explosion",
    "Advice on protection against fire", "Fire and explosion protection",
]
HANDLING_ENDS = ["Madde veya Karışımların Uyuşmazlıkları", "Çevre İle İlgili Uyarılar", "Ek Uyarılar"]
FIRE_ENDS = ["7.1.1.2", "Madde veya Karışımların Uyuşmazlıkları", "Çevre İle İlgili Uyarılar"]
STORAGE = [
    "Depolama Koşulları", "Depolama Şartları", "Saklama Koşulları", "Saklama Şartları", "Further information about storage conditions", "Storage conditions", "Conditions for safe storage",
    "Requirements for storage areas and containers",
]
STORAGE_HEADINGS = ["Uyuşmazlıkları da içeren güvenli depolama için koşullar", "Uyuşmazlıkları da içeren güvenli depolama koşulları", "Conditions for safe storage, including any incompatibilities"]
STORAGE_CLASSES = ["Alman depolama sınıfı (TRGS 510)", "Alman depolama sınıfı", "Depolama sınıfı", "Storage class"]
INCOMPATIBLE = [
    "Uyumsuz Maddeler", "Uyumsuz malzemeler", "Uyuşmayan malzemeler", "Madde veya Karışımların Uyuşmazlıkları İle İlgili Uyarılar", "Birlikte depolanmaması gereken malzemeler",
    "Birlikte depolamayın", "Information about storage in one common storage facility", "Incompatible materials", "Materials to avoid",
]
STORAGE_ENDS = ["Ortak Depolama Şartları", "Maksimum Depolama Süresi"]
#: Labels of a storage class and what ends it.
STORAGE_CLASS = {"Depolama sınıfı": ["Uyumsuz malzemeler", "Uyumsuz Maddeler", "Uyuşmayan malzemeler", "Incompatible materials"], "Storage class": [".", ";"]}
INCOMPATIBLE_ENDS = ["7.3", "Belirli Son Kullanımlar", "Specific end uses", "Specific end use"]
END_USE = ["Spesifik kullanım (lar)", "Spesifik kullanımlar", "Specific end use (s)", "Specific end uses", "Specific use (s)"]
END_USE_HEADINGS = ["Belirli son kullanım (lar)", "Belirli son kullanımlar", "Specific end use (s)", "Specific end uses"]
END_USE_ENDS = ["Tanımlanan Kullanımlar", "Tanımlanmış Kullanımlar", "Risk Yönetim Yöntemleri", "Risk Yönetim Önlemleri", "Identified uses", "Risk management measures", "RMM"]

# Labels of section 8, each of which a number like 8.2.1 may lead, and what else ends a value.
PROTECTION = {
    "engineering_controls": ["Uygun mühendislik kontrolleri", "Mühendislik kontrolleri", "Mühendislik önlemleri", "Teknik kontroller", "Appropriate engineering controls", "Engineering controls", "Engineering measures"],
    "respiratory_protection": ["Solunum korunması", "Solunum sisteminin korunması", "Solunum ile ilgili önlemler", "Solunumun korunması", "Solunum koruması", "Respiratory protection", "Breathing protection"],
    "hand_protection": ["Ellerin korunması", "Elleri koruma", "El koruması", "El korunması", "Hand protection"],
    "eye_face_protection": [
        "Göz / yüz korunması", "Göz / yüz koruması", "Göz ve yüz korunması", "Göz ve yüz koruması", "Gözlerin / yüzün korunması", "Gözlerin korunması", "Gözleri koruma",
        "Göz koruması", "Eye / face protection", "Eye and face protection", "Eye protection",
    ],
    "body_protection": [
        "Cildin ve vücudun korunması", "Cilt ve vücudun korunması", "Deri ve vücudun korunması", "Cildin korunması", "Deri korunması", "Vücudun korunması", "Vücut koruması",
        "Skin and body protection", "Skin protection", "Body protection",
    ],
    "hygiene_measures": ["Genel hijyen hususları", "Genel hijyen önlemleri", "Sağlık tedbirleri", "Hijyen önlemleri", "General hygiene considerations", "General hygiene measures", "Hygiene measures"],
    "environmental_controls": ["Çevresel maruziyet kontrolleri", "Çevresel maruz kalma kontrolleri", "Environmental exposure controls"],
}
PROTECTION_NUMBER = r"(?:(?<!\d)8(?:\s*\.\s*\d+){1,4}\s*\.?\s*(?!\d))?"
PROTECTION_ENDS = [
    r"(?<!\d)8\s*\.\s*2\s*\.\s*3\s*\.?(?!\d)", r"(?<!\d)8\s*\.\s*[12]\s*\.?(?!\d)", r"Biyolojik\s+mesleki\s+maruziyet\s+limitleri", r"Biological\s+limit\s+values", r"(?:BÖLÜM|SECTION)\s+9\b",
    r"(?<!\d)9\s*\.\s*1\s*\.?(?!\d)",
]
# Words of lines with exposure limits, DNELs and PNECs; of table headings, and of measured limits.
LIMIT_WORDS = ["maruz kalma limit", "maruziyet limit", "mesleki maruziyet", "occupational exposure", "exposure limit", "twa", "stel", "ceiling", "pel", "tlv", "ngv", "kgv", "osha", "acgih"]
DNEL_WORDS = ["dnel", "derived no effect", "derived no-effect"]
PNEC_WORDS = ["pnec", "öngörülen etkisiz konsantrasyon", "predicted no effect", "predicted no-effect"]
LIMIT_TABLE_WORDS = ["kaynak twa", "twa8", "stel9", "twa (8 saat)", "stel (15"]
LIMIT_MEASURE = r"\b\d+(?:[.,]\d+)?\s*(?:ppm|mg\s*/\s*m[3³])"
LIMIT_UNIT = r"\b(?:ppm|mg/m3|mg/m³|twa|stel|pel|tlv)\b"
# Words of engineering controls, glove materials and hygiene; headings above engineering controls.
ENGINEERING_WORDS = ["havalandır", "ventilat", "lokal emiş", "local exhaust", "göz yıkama", "eye wash", "eyewash", "duş", "shower", "kapalı sistem", "closed system", "maruziyet sınır", "maruz kalma sınır", "işverenin uygun olduğu", "mühendislik kontrol", "engineering control"]
ENGINEERING_HEADINGS = ["Maruz kalma kontrolleri", "Kişisel koruyucu ekipman", "Kişisel koruyucu donanım", "Exposure controls"]
GLOVE_WORDS = ["nitril", "nitrile", "kauçuk", "rubber", "bütil", "butil", "butyl", "neopren", "neoprin", "neoprene", "pvc", "polivinil", "latex", "viton", "eval", "polietilen", "polyethylene"]
HYGIENE_WORDS = ["ellerinizi yık", "elleri yık", "kirlenmiş giysi", "kirli kıyafet", "wash hands", "contaminated clothing", "sigara", "yemeyin", "içmeyin"]

# Labels before which the structure normaliser starts a new line, by the part of the sheet they stand in.
STRUCTURE_LABELS = {
    "section 1": [
        "Ürün Adı", "Ürün İsmi", "Ticari Adı", "Madde Adı", "Madde/Karışım Adı", "Ürün Kodu(ları)", "Ürün Kodu", "Product name", "Product identifier", "Product code", "Benzersiz Formül Tanımlayıcı (UFI)", "UFI",
        "REACH kayıt numarası", "REACH registration number", "Tedarikçi", "Üretici", "Firma Adı", "Şirket Adı", "Supplier", "Manufacturer",
    ],
    "section 2": [
        "Madde veya karışımın sınıflandırılması", "Madde ve Karışımın Sınıflandırılması", "Classification of the substance or mixture", "Etiket unsurları", "Label elements", "Uyarı kelimesi", "Signal word",
        "Zararlılık İfadeleri", "Hazard statements", "Önlem İfadeleri", "Precautionary statements", "Zararlılık İşaretleri", "Piktogramlar", "Pictograms", "Diğer zararlar", "Other hazards",
    ],
    "revision": [
        "Hazırlama Tarihi", "Hazırlanma Tarihi", "Yeni Düzenleme Tarihi", "Yeniden Düzenleme Tarihi", "Yeniden Düzenlenme Tarihi", "Revizyon tarihi", "Revision date", "Date of revision", "Düzenleme Sayısı",
        "Kaçıncı Düzenleme Olduğu", "Revizyon Numarası", "Revision Number", "Version", "Sürüm",
    ],
    "section 7": [
        "güvenli elleçleme", "elleçleme", "kullanım", "güvenli çalışma", "handling", "safe handling", "precautions for safe handling", "depolama", "güvenli depolama", "depolama koşulları", "depolama şartları", "storage",
        "storage conditions", "conditions for safe storage", "uyuşmaz", "uyumsuz", "bağdaşmaz", "incompatible", "incompatibilities", "keep away from", "uzak tutul", "ayrı muhafaza", "oksitleyici", "indirgeme ajan",
        "reducing agent", "oxidizing agent", "oxidising agent", "yangın", "patlama", "tutuş", "alev", "ateş", "fire", "explosion", "ignition", "flame", "belirli son kullanımlar", "specific end use", "specific end uses",
    ],
    "section 8": [
        "Kişisel koruyucu ekipman", "Kişisel Koruyucu Donanımlar", "Maruz Kalma Limitleri", "Mesleki maruziyet limitleri", "İşçiler için DNELs", "Genel nüfus için DNELs", "Öngörülen Etkisiz Konsantrasyon", "PNEC", "DNEL",
        "solunum korunması", "solunum koruması", "solunum sisteminin korunması", "solunum ile ilgili önlemler", "malzeme buharlarını solunum yolu ile alma", "respiratory protection", "breathing protection",
        "ellerin korunması", "el koruması", "elleri koruma", "hand protection", "cildin korunması", "derinin korunması", "skin protection", "göz korunması", "gözlerin korunması", "göz/yüz korunması",
        "göz / yüz korunması", "göz koruması", "eye protection", "eye/face protection", "eye face protection", "vücudun korunması", "vücut koruması", "diğer koruyucu ekipman", "body protection",
        "protective clothing", "uygun mühendislik kontrolleri", "mühendislik kontrolleri", "uygun teknik kontroller", "engineering controls", "çevresel maruziyet kontrolleri", "çevresel maruz kalma kontrolleri",
        "environmental exposure controls", "sağlık tedbirleri", "hijyen önlemleri", "genel güvenlik ve hijyen önlemleri", "genel koruyucu ve hijyen önlemleri", "hygiene measures", "general hygiene measures",
    ],
    "section 9": [
        "Sıvı Yoğunluğu", "Yığın yoğunluğu", "Buhar yoğunluğu", "Kendiliğinden tutuşma sıcaklığı", "Bozunma sıcaklığı", "Havadaki Alevlenebilirlik Limiti", "Özellik", "Değerler", "Notlar", "Yöntem",
    ],
}
# Names of the physical properties in plain lines, for the layout helpers and the structure normaliser.
PROPERTY_NAMES = {
    "physical_state": ["görünüş", "görünüm", "fiziksel hali", "fiziksel hal", "fiziksel durum", "toplama durumu", "physical state", "appearance"],
    "color": ["renk", "color", "colour"],
    "odor": ["koku", "odor", "odour"],
    "ph": ["ph", "ph değeri", "ph value"],
    "melting_freezing_point": ["erime noktası", "donma noktası", "erime noktası / donma noktası", "erime noktası/donma noktası", "melting point", "freezing point"],
    "boiling_point": ["kaynama noktası", "kaynama noktası / kaynama aralığı", "kaynama noktası/kaynama aralığı", "boiling point", "initial boiling point"],
    "flash_point": ["parlama noktası", "tutuşma derecesi", "flash point"],
    "vapour_pressure": ["buhar basıncı", "vapor pressure", "vapour pressure"],
    "density": ["yoğunluk", "bağıl yoğunluk", "nispi yoğunluk", "özgül ağırlık", "density", "relative density", "specific gravity"],
    "viscosity": ["viskozite", "kinematik viskozite", "dinamik viskozite", "akışkanlık", "viscosity", "kinematic viscosity", "dynamic viscosity"],
    "solubility": ["çözünürlük", "çözünürlüğü", "suda çözünürlük", "suda çözünürlüğü", "su içinde çözünürlük", "solubility", "solubility in water"],
    "flammability": ["alevlenirlik", "yanıcılık", "flammability"],
    "explosive_properties": ["patlayıcılık özellikleri", "patlama özellikleri", "patlayıcı özellikler", "explosive properties"],
    "oxidising_properties": ["oksitleyici özellikler", "oxidising properties", "oxidizing properties"],
    "lower_explosion_limit": ["alt patlama limiti", "alt patlama sınırı", "alevlenme alt limiti", "lower explosion limit", "lower flammability limit"],
    "upper_explosion_limit": ["üst patlama limiti", "üst patlama sınırı", "alevlenme üst limiti", "upper explosion limit", "upper flammability limit"],
}
# Labels that lost the blank before their value, with those values.
JOINED_VALUES = {"Uyarı kelimesi": ["Dikkat", "Tehlike", "Warning", "Danger"], "Signal word": ["Warning", "Danger"]}
# Words that earlier normalising split at a label inside them, with a colon where; the last is a stem.
BAD_SPLITS = ["renk:siz", "koku:suz", "DNEL:s", "PNEC:s", "teleph:one", "tripolyph:osph:ate", "tripolyph:osphate", "kullanım:ları", "Uyuşmaz:lıkları"]
BAD_SPLIT_STEMS = ["alev:len"]
