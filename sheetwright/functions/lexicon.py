"""Fixed values of the safety-data-sheet domain: labels, codes, tables. Data only."""

# Single-character and multi-character repairs of broken extraction, in their order.
CHARACTER_REPAIRS = {
    "Ģ": "ş", "ġ": "Ş", "Ġ": "İ", "ý": "ı", "Ý": "İ",
    "Ã§": "ç", "Ã‡": "Ç", "Ã¼": "ü", "Ãœ": "Ü", "Ã¶": "ö", "Ã–": "Ö", "ÄŸ": "ğ", "Äž": "Ğ", "ÅŸ": "ş", "Åž": "Ş", "Ä±": "ı", "Ä°": "İ",
    "\u00a0": " ", "\u200b": "", "\ufeff": "",
}

# Words of which one must follow a section's heading.
SECTION_TITLES = {
    1: ["kimliği", "kimligi", "identification"],
    2: ["zararlılık", "zararlilik", "hazard"],
    3: ["bileşim", "bilesim", "içindekiler", "icindekiler", "composition", "ingredients"],
    4: ["ilk yardım", "first aid"],
    5: ["yangın", "yangin", "firefighting", "fire-fighting"],
    6: ["kaza sonucu", "yayılma", "yayilma", "accidental release"],
    7: ["elleçleme", "ellecleme", "depolama", "handling", "storage"],
    8: ["maruz kalma", "maruziyet", "kişisel korunma", "kisisel korunma", "exposure controls", "personal protection"],
    9: ["fiziksel", "kimyasal özellik", "kimyasal ozellik", "physical", "chemical properties"],
    10: ["kararlılık", "kararlilik", "tepkime", "stability", "reactivity"],
    11: ["toksikolojik", "toksikoloji", "toxicological"],
    12: ["ekolojik", "ecological"],
    13: ["bertaraf", "atık", "atik", "disposal"],
    14: ["taşımacılık", "tasimacilik", "transport"],
    15: ["mevzuat", "regulatory"],
    16: ["diğer bilgiler", "diger bilgiler", "other information"],
}
# Beginnings that make a heading a mere reference.
REFERENCE_STARTS = ["for information", "for more information", "see ", "refer to ", "reference to ", "bkz", "bakiniz"]

# Markers of a data sheet (the first stands twice and counts twice) and of an instruction.
SHEET_MARKERS = [
    "GÜVENLİK BİLGİ FORMU", "GÜVENLİK BİLGİ FORMU", "SAFETY DATA SHEET", "SAFETY DATA", "ZARARLILIK TANIMLANMASI", "TEHLİKELERİN TANIMLANMASI", "HAZARDS IDENTIFICATION",
    "BİLEŞİMİ/İÇİNDEKİLER", "COMPOSITION/INFORMATION", "İLK YARDIM ÖNLEMLERİ", "FIRST AID MEASURES", "YANGINLA MÜCADELE", "FIREFIGHTING MEASURES", "ELLEÇLEME VE DEPOLAMA",
    "HANDLING AND STORAGE", "MARUZ KALMA KONTROLLERİ", "EXPOSURE CONTROLS", "FİZİKSEL VE KİMYASAL ÖZELLİKLER", "PHYSICAL AND CHEMICAL PROPERTIES", "TOKSİKOLOJİK BİLGİLER",
    "TOXICOLOGICAL INFORMATION", "EKOLOJİK BİLGİLER", "ECOLOGICAL INFORMATION", "TAŞIMACILIK BİLGİLERİ", "TRANSPORT INFORMATION", "MEVZUAT BİLGİLERİ", "REGULATORY INFORMATION",
    "DİĞER BİLGİLER", "OTHER INFORMATION",
]
INSTRUCTION_MARKERS = ["HAZARDOUS MATERIAL INSTRUCTION", "HAZARDOUS MATERIAL INFORMATION"]
# What the confidence score looks for.
SCORE_TITLES = ["GÜVENLİK BİLGİ FORMU", "SAFETY DATA SHEET", "MATERIAL SAFETY DATA SHEET"]
SCORE_HEADINGS = [
    ["ZARARLILIK TANIMLANMASI", "HAZARDS IDENTIFICATION"], ["İLK YARDIM", "FIRST AID"], ["YANGINLA MÜCADELE", "FIREFIGHTING"], ["ELLEÇLEME VE DEPOLAMA", "HANDLING AND STORAGE"],
    ["MARUZİYET KONTROLLERİ", "EXPOSURE CONTROLS"], ["FİZİKSEL VE KİMYASAL", "PHYSICAL AND CHEMICAL"], ["TOKSİKOLOJİ", "TOXICOLOGICAL"], ["TAŞIMACILIK", "TRANSPORT INFORMATION"],
    ["MEVZUAT", "REGULATORY INFORMATION"],
]
SCORE_CHEMISTRY = ["CAS", "REACH", "H315", "H319", "H400", "H410", "P280", "UFI"]
# Statements that nothing is classified.
NOT_CLASSIFIED = [
    "sınıflandırılmamıştır", "sınıflandırılmamış", "tehlikeli olarak sınıflandırılmamıştır", "zararlı olarak sınıflandırılmamıştır", "etiketleme yok",
    "no classification", "not classified", "not classified as hazardous", "no labelling", "no labeling",
]

# Values that say nothing, values that say there are no data, names that are labels.
PLACEHOLDERS = ["", ":", "::", "-", "--", "---", "—", "_", "/", "\\", ".", "..", "..."]
NO_DATA = [
    "bilgi yok", "bilgi bulunmamaktadır", "veri yok", "veri yoktur", "uygulanabilir değil", "uygulanamaz", "uygun veri yoktur", "mevcut değildir", "belirlenmemiş", "bilinmiyor",
    "not available", "no data available", "not applicable", "not determined",
]
LABEL_NAMES = ["bilgisi", "adı", "firma", "firma bilgisi", "şirket", "şirket bilgisi", "üretici", "tedarikçi", "manufacturer", "supplier", "company"]

# Labels of a product's name in section 1, in their order, and what ends its value.
NAME_LABELS = [r"Ürün\s+Adı", r"Ürün\s+İsmi", r"Ticari\s+Adı", r"Madde\s+Adı", r"Madde/Karışım\s+Adı", r"Product\s+Name", r"Product\s+Identifier", r"Trade\s+Name"]
NAME_ENDS = [r"Ürün\s+Kodu", r"Product\s+Code", r"Article\s+(?:No|Number)", "UFI", r"Benzersiz\s+Formül", "REACH", r"CAS(?:\s+No\.?)?", r"EC(?:\s+No\.?)?", r"1\.2\b", r"1\.3\b", r"1\.4\b"]
# Labels of a product's name in any line.
NAME_LINE_LABELS = [
    r"Madde\s+Adı", r"Madde/Karışım\s+Adı", r"Madde/Karışımın\s+Adı", r"Ürün\s+ismi", r"Ürün\s+adı", r"Ticari\s+ismi", r"Ticari\s+adı", r"Product\s+name", r"Trade\s+name", r"Commercial\s+name",
    r"Product\s+identifier",
]
# Labels of a manufacturer in section 1, what ends its value, and values that are none.
MAKER_LABELS = [
    r"Üretici(?:\s*/\s*Tedarikçi)?", r"İmalatçı(?:\s*/\s*Tedarikçi)?", r"Tedarikçi(?:\s*/\s*Üretici)?", r"Manufacturer(?:\s*/\s*Supplier)?", r"Supplier(?:\s*/\s*Manufacturer)?", r"Firma\s+Adı",
    r"Şirket\s+Adı", "Firma", r"Company\s+Name",
]
MAKER_ENDS = ["Address", "Adres", "Telefon", "Telephone", "Phone", r"Tel\.?", "Fax", "E-?mail", "E-posta", "Email", "Web", "Website", r"www\."]
NOT_MAKERS = ["undertaking", "company/undertaking", "the company/undertaking", "company", "supplier", "manufacturer", "details", "information"]
# Labels of a manufacturer in any line, and what is taken off the front of one, in their order.
MAKER_LINE_LABELS = ["Tedarikçi", "Üretici", r"Firma\s+Adı", r"Şirket\s+Adı", "Manufacturer", "Supplier", "Company"]
MAKER_PREFIXES = [r"Firma\s+Adı", r"Şirket\s+Adı", "Üretici", "İmalatçı", "Tedarikçi", "Manufacturer", "Supplier", "Company", "Adı"]

# Months in Turkish and English, folded.
MONTHS = {
    "oca": 1, "ocak": 1, "sub": 2, "subat": 2, "mar": 3, "mart": 3, "nis": 4, "nisan": 4, "may": 5, "mayis": 5, "haz": 6, "haziran": 6, "tem": 7, "temmuz": 7, "agu": 8, "agustos": 8,
    "eyl": 9, "eylul": 9, "eki": 10, "ekim": 10, "kas": 11, "kasim": 11, "ara": 12, "aralik": 12,
    "jan": 1, "january": 1, "feb": 2, "february": 2, "march": 3, "apr": 4, "april": 4, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
# Labels of dates and versions, first ones first.
REVISION_LABELS = [
    r"Yeniden\s+Düzenlenme\s+ve\s+Yayın\s+Tarihi", r"Yeniden\s+Düzenleme\s+ve\s+Yayın\s+Tarihi", r"Yeniden\s+Düzenlenme\s+ve\s+Yayım\s+Tarihi", r"Yeniden\s+Düzenleme\s+ve\s+Yayım\s+Tarihi",
    r"Yeniden\s+Düzenlenme\s+Tarihi", r"Yeniden\s+Düzenleme\s+Tarihi", r"Yeni\s+Düzenlenme\s+Tarihi", r"Yeni\s+Düzenleme\s+Tarihi", r"Güncelleme\s+Tarihi", r"Gözden\s+Geçirilme\s+Tarihi",
    r"Tarih\s*/\s*Gözden\s+Geçirilme\s+Tarihi", r"Revizyon\s+Tarihi", r"Revision\s+date", r"Date\s+of\s+revision", r"Date\s+of\s+last\s+revision", r"Last\s+revision", r"Revised\s+on",
    r"Updated\s+on", r"Update\s+date", r"Date\s+of\s+update", r"Revision(?!\s+(?:number|no\.?))", r"Revizyon(?!\s+(?:numarası|numarasi|no\.?))",
]
PREPARATION_LABELS = [
    r"Hazırlanma\s+Tarihi", r"Hazırlama\s+Tarihi", r"İlk\s+Hazırlanma\s+Tarihi", r"İlk\s+Düzenlenme\s+Tarihi", r"İlk\s+Düzenleme\s+Tarihi", r"Düzenlenme\s+Tarihi", r"Düzenleme\s+Tarihi",
    r"Yayın\s+Tarihi", r"Yayım\s+Tarihi", r"Preparation\s+date", r"Date\s+of\s+preparation", r"Issue\s+date", r"Date\s+of\s+issue", r"First\s+issue\s+date",
]
VERSION_LABELS = [
    r"Kaçıncı\s+Düzenleme\s+Olduğu", r"Düzenleme\s+Sayısı", r"Düzenleme\s+Numarası", r"Düzenleme\s+No\.?", r"Revizyon\s+Numarası", r"Revizyon\s+No\.?", r"Revision\s+Number", r"Revision\s+No\.?",
    r"Version\s+number", r"Version\s+No\.?", r"Version(?!\s+(?:number|no\.?))", r"Sürüm\s+Numarası", r"Sürüm\s+No\.?", r"Sürüm",
]
# Labels of a product code, in the order in which they count.
PRODUCT_CODE_LABELS = [r"Ürün\s+Kodu(?:\s*\(\s*ları\s*\))?", r"Ürün\s+Kodları", r"Product\s+Code(?:\(s\))?", r"Article\s+(?:No|Number)\.?"]
VERSION_WORDS = ["number", "no", "numara", "numarası", "numarasi", "sayısı", "sayisi"]

# Official letter suffixes of hazard codes, in their canonical case.
HAZARD_SUFFIXES = {"350": ["i"], "360": ["F", "D", "FD", "DF"], "361": ["f", "d", "fd", "df"]}
# The pictogram that a hazard code implies.
PICTOGRAMS = {
    "H220": "GHS02", "H221": "GHS02", "H224": "GHS02", "H225": "GHS02", "H226": "GHS02", "H270": "GHS03", "H271": "GHS03", "H272": "GHS03", "H290": "GHS05", "H300": "GHS06", "H302": "GHS07",
    "H304": "GHS08", "H310": "GHS06", "H312": "GHS07", "H314": "GHS05", "H315": "GHS07", "H317": "GHS07", "H318": "GHS05", "H319": "GHS07", "H330": "GHS06", "H332": "GHS07", "H334": "GHS08",
    "H335": "GHS07", "H336": "GHS07", "H340": "GHS08", "H341": "GHS08", "H350": "GHS08", "H351": "GHS08", "H360": "GHS08", "H361": "GHS08", "H370": "GHS08", "H371": "GHS08", "H372": "GHS08",
    "H373": "GHS08", "H400": "GHS09", "H410": "GHS09", "H411": "GHS09",
}

# Control banding.
HAZARD_GROUPS = {
    "A": ["H304", "H315", "H319", "H336", "EUH066", "EU66"],
    "B": ["H302", "H312", "H332", "H371"],
    "C": ["H301", "H311", "H314", "H317", "H318", "H331", "H335", "H370", "H373", "EUH071", "EU71"],
    "D": ["H300", "H310", "H330", "H351", "H360", "H361", "H362", "H372"],
    "E": ["H334", "H340", "H341", "H350", "EUH070", "EU70"],
}
SKIN_EYE = ["H310", "H311", "H312", "H314", "H315", "H317", "H318", "H319", "EUH070", "EU70"]
# Control approach of a hazard group, by amount and exposure.
CONTROL_MATRIX = {
    "A": {
        "Small": {"Low": 1, "MediumSolid": 1, "MediumLiquid": 1, "High": 1},
        "Medium": {"Low": 1, "MediumSolid": 1, "MediumLiquid": 1, "High": 2},
        "Large": {"Low": 1, "MediumSolid": 2, "MediumLiquid": 1, "High": 2},
    },
    "B": {
        "Small": {"Low": 1, "MediumSolid": 1, "MediumLiquid": 1, "High": 1},
        "Medium": {"Low": 1, "MediumSolid": 2, "MediumLiquid": 2, "High": 2},
        "Large": {"Low": 1, "MediumSolid": 3, "MediumLiquid": 2, "High": 3},
    },
    "C": {
        "Small": {"Low": 1, "MediumSolid": 1, "MediumLiquid": 2, "High": 2},
        "Medium": {"Low": 2, "MediumSolid": 3, "MediumLiquid": 3, "High": 3},
        "Large": {"Low": 2, "MediumSolid": 4, "MediumLiquid": 4, "High": 4},
    },
    "D": {
        "Small": {"Low": 2, "MediumSolid": 2, "MediumLiquid": 3, "High": 3},
        "Medium": {"Low": 3, "MediumSolid": 4, "MediumLiquid": 4, "High": 4},
        "Large": {"Low": 3, "MediumSolid": 4, "MediumLiquid": 4, "High": 4},
    },
    "E": {
        "Small": {"Low": 4, "MediumSolid": 4, "MediumLiquid": 4, "High": 4},
        "Medium": {"Low": 4, "MediumSolid": 4, "MediumLiquid": 4, "High": 4},
        "Large": {"Low": 4, "MediumSolid": 4, "MediumLiquid": 4, "High": 4},
    },
}
AMOUNTS = ["Small", "Medium", "Large"]
EXPOSURES = ["Low", "MediumSolid", "MediumLiquid", "High"]
# Number: title and guidance sheet.
CONTROL_APPROACHES = {1: ("Genel Havalandırma", "G100"), 2: ("Mühendislik Kontrolü / Lokal Emiş", "G200"), 3: ("Kapalı Sistem / Containment", "G300"), 4: ("Uzman Tavsiyesi / Özel Kontrol", "G400")}
AMOUNT_UNITS = {"Small": ["g", "gram", "grams", "ml"], "Medium": ["kg", "kilogram", "kilograms", "l", "lt", "litre", "liter"], "Large": ["ton", "tonne", "tonnes", "t", "m3", "m³"]}
DUSTINESS = {"Low": ["düşük", "dusuk", "low"], "Medium": ["orta", "medium"], "High": ["yüksek", "yuksek", "high"]}
SOLID, LIQUID = ["katı", "kati", "solid"], ["sıvı", "sivi", "liquid"]
# The physical form that needs a dustiness, and why a use can't be assessed, in the order of the checks.
SOLID_FORM = "Katı"
REFUSALS = [
    "Önce değerlendirme yapılacak kimyasalı seçin.", "Değerlendirme için güncel SDS gereklidir.", "Proses / faaliyet adını girin.", "Kullanılan miktarı girin.", "Fiziksel formu seçin.",
    "Katı kimyasal için tozluluk seviyesini seçin.",
]
# Recommendations of each control approach, and those of further conditions.
RECOMMENDATIONS = {
    1: [
        "Çalışma alanında yeterli genel havalandırma sağlayın.",
        "Kimyasalın gereksiz açıkta kalmasını ve dökülmesini önleyin.",
        "İyi endüstriyel hijyen uygulamalarını sürdürün.",
    ],
    2: [
        "Kimyasalın açığa çıktığı noktada lokal emiş havalandırması (LEV) kullanın.",
        "Emiş sisteminin kimyasal kaynağına mümkün olduğunca yakın olmasını sağlayın.",
        "LEV sisteminin bakım ve performans kontrollerini planlı olarak gerçekleştirin.",
    ],
    3: [
        "Prosesi mümkün olduğunca tamamen kapalı sistem içerisinde yürütün.",
        "Transfer ve dolum noktalarında kapalı bağlantılar tercih edin.",
        "Bakım ve arıza durumları için kontrollü müdahale prosedürü oluşturun.",
    ],
    4: [
        "Yetkin iş hijyeni / İSG uzmanından prosese özgü değerlendirme alın.",
        "Maruziyet ölçümü ve sağlık gözetimi gereksinimini değerlendirin.",
        "İkame, tam kapalı sistem ve ileri mühendislik kontrollerini değerlendirin.",
    ],
}
SKIN_EYE_ADVICE = [
    "Cilt ve göz temasını önleyecek uygun kimyasal koruyucu eldiven, gözlük/yüz siperi ve koruyucu giysi seçimini değerlendirin.",
    "Cilt/göz temasına yönelik S100, S101 ve S102 kontrol rehberlerini dikkate alın.",
]
NO_CONTROLS_ADVICE = "Mevcut kontrol tedbirleri kayıt altına alınmamış; değerlendirme tamamlanmadan önce mevcut kontroller doğrulanmalıdır."
DUST_ADVICE = "Toz oluşumunu azaltacak çalışma yöntemleri ve temizlik prosedürleri uygulayın; kuru süpürme gibi toz kaldıran yöntemlerden kaçının."
# Names of amounts and exposures, and the texts of an assessment's workbook.
AMOUNT_NAMES = {"Small": "Küçük", "Medium": "Orta", "Large": "Büyük"}
EXPOSURE_NAMES = {"Low": "Düşük", "Medium": "Orta", "High": "Yüksek"}
EXPORT = {
    "sheets": ["COSHH Analiz Tablosu", "Değerlendirme Özeti", "Kontrol Faaliyetleri", "H-P-GHS Kodları"],
    "widths": [[28, 18, 24, 24, 28, 24, 20, 18, 22, 18, 18, 22, 20, 20, 18, 30, 20, 45, 60, 30], [38, 85], [10, 100], [20, 30]],
    "columns": [
        "Tehlikeli Madde", "CAS No", "Maruziyet Sınır Değeri", "Kullanılan Bölüm", "Maruz Kalan Çalışan / Görev", "H Kodları", "GHS", "Tehlike Grubu", "Günlük Kullanım Miktarı", "Miktar Grubu", "Fiziksel Form",
        "Tozluluk / Uçuculuk", "Kaynama Noktası", "Proses Sıcaklığı", "Cilt / Göz Grubu", "Kontrol Yaklaşımı", "Kontrol Rehberi", "Mevcut Kontroller", "Önerilen Kontrol Faaliyetleri", "Değerlendirme Durumu",
    ],
    "title": "ILO / COSHH KİMYASAL MARUZİYET RİSK DEĞERLENDİRMESİ",
    "summary": [
        "Kimyasal", "Üretici", "CAS No", "SDS ID", "SDS Revizyon", "Proses / Faaliyet", "Bölüm", "Maruz Kalan Çalışan / Görev", "Maruziyet Sınır Değeri", "Kullanılan Miktar", "Fiziksel Form", "Tozluluk", "Kaynama Noktası",
        "Proses Sıcaklığı", "Tehlike Grubu", "Tehlike Grubu ile Eşleşen H Kodları", "Miktar Grubu", "Tozluluk / Uçuculuk Grubu", "Cilt / Göz Grubu", "Kontrol Yaklaşımı", "Kontrol Rehberi", "Skin Rehberleri", "Analiz Durumu",
        "H Kodları", "P Kodları", "GHS Kodları", "Metodoloji", "Uyarı",
    ],
    "controls": {"closed_system": "Kapalı sistem", "local_exhaust": "LEV", "general_ventilation": "Genel havalandırma", "existing_ppe": "KKD"},
    "advice": ["No", "Önerilen Kontrol Faaliyeti"],
    "no_advice": "Öneri oluşturulamadı. Uzman incelemesi gerekli.",
    "codes": ["Kategori", "Kod"],
    "kinds": {"H": "H Kodu", "P": "P Kodu", "GHS": "GHS Kodu"},
    "no_codes": ["Bilgi", "Tehlike kodu bulunamadı."],
    "review": "Uzman incelemesi gerekli", "done": "Ön değerlendirme tamamlandı", "look": "İnceleme gerekli", "expert": "Uzman incelemesi", "unknown": "Belirlenemedi", "skin_sheets": "S100, S101, S102",
    "method": "ILO International Chemical Control Toolkit / HSE COSHH Essentials control banding",
    "warning": "Bu sonuç kontrol banding esaslı bir ön değerlendirmedir. İşyeri risk değerlendirmesi, maruziyet ölçümleri, mesleki maruziyet sınırları ve uzman değerlendirmesinin yerine geçmez.",
}
STATUS_LABELS = {
    "pending": "Bekliyor", "processing": "İşleniyor", "uploaded": "Yüklendi", "classified": "Sınıflandırıldı", "sections_extracted": "Bölümler Çıkarıldı", "needs_review": "İnceleme Gerekli",
    "failed": "Hata", "completed": "Tamamlandı",
}
MONTH_NAMES = ["Oca", "Şub", "Mar", "Nis", "May", "Haz", "Tem", "Ağu", "Eyl", "Eki", "Kas", "Ara"]
TEST_NAMES = ["string", "test", "test product", "test manufacturer"]

# Labels of the physical properties in section 9, as patterns.
PROPERTY_LABELS = {
    "physical_state": [r"Fiziksel\s+hal(?:i)?", r"Fiziksel\s+durum", r"Toplama\s+durumu", r"Physical\s+state", r"Appearance", r"Görünüş", r"Görünüm"],
    "color": [r"Renk", r"Colou?r"],
    "odor": [r"Koku(?!\s+eşiği)", r"Odou?r(?!\s+threshold)"],
    "ph": [r"pH\s+değeri", r"pH\s+value", r"pH"],
    "melting_freezing_point": [r"Erime\s+noktası\s*/\s*donma\s+noktası", r"Erime\s+noktası", r"Donma\s+noktası", r"Melting\s+point\s*/\s*freezing\s+point", r"Melting\s+point", r"Freezing\s+point"],
    "boiling_point": [
        r"Kaynama\s+noktası\s+veya\s+başlangıç\s+kaynama\s+noktası\s+ve\s+kaynama\s+aralığı", r"Kaynama\s+noktası\s*/\s*kaynama\s+aralığı", r"Kaynama\s+noktası", r"Kaynama\s+aralığı",
        r"Boiling\s+point\s+or\s+initial\s+boiling\s+point\s+and\s+boiling\s+range", r"Boiling\s+point\s*/\s*boiling\s+range", r"Boiling\s+point", r"Boiling\s+range",
    ],
    "flash_point": [r"Parlama\s+noktası", r"Flash\s+point"],
    "vapour_pressure": [r"Buhar\s+basıncı", r"Vapou?r\s+pressure"],
    "density": [r"Density\s+and/or\s+relative\s+density", r"Sıvı\s+yoğunluğu", r"Kütle\s+yoğunluğu", r"Özgül\s+ağırlık", r"Bağıl\s+yoğunluk", r"Nispi\s+yoğunluk", r"Relative\s+density", r"Specific\s+gravity", r"Density", r"Yoğunluk"],
    "viscosity": [r"Kinematik\s+viskozite", r"Dinamik\s+viskozite", r"Akışkanlık\s*\(viskozite\)", r"Viskozite", r"Kinematic\s+viscosity", r"Dynamic\s+viscosity", r"Viscosity"],
    "solubility": [
        r"Suda\s+çözünürlüğü", r"Suda\s+çözünürlük", r"Su\s+içinde\s+çözünürlüğü", r"Su\s+içinde\s+çözünürlük", r"Çözünürlüğü\s*\(su\s+içinde\)", r"Çözünürlük\s*\(ler\)", r"Çözünürlük",
        r"Solubility\s+in\s+water", r"Solubility",
    ],
    "flammability": [r"Alevlenebilirlik\s*\(katı,\s*gaz\)", r"Alevlenebilirlik", r"Alevlenirlik", r"Yanıcılık", r"Flammability"],
    "explosive_properties": [r"Patlayıcılık\s+özellikleri", r"Patlayıcılık\s+özellikler", r"Patlama\s+özellikleri", r"Patlayıcı\s+özellikler", r"Explosive\s+properties"],
    "oxidising_properties": [r"Oksitleyici\s+özellikler", r"Oxidi[sz]ing\s+properties"],
    "lower_explosion_limit": [r"Alt\s+alevlenebilirlik\s+veya\s+patlama\s+limitleri", r"Alt\s+(?:alevlenirlik|alevlenebilirlik|patlama)\s+(?:limiti|limitleri|sınırı)", r"Lower\s+(?:explosion|flammability)\s+limit"],
    "upper_explosion_limit": [r"Üst\s+alevlenebilirlik\s+veya\s+patlama\s+limitleri", r"Üst\s+(?:alevlenirlik|alevlenebilirlik|patlama)\s+(?:limiti|limitleri|sınırı)", r"Upper\s+(?:explosion|flammability)\s+limit"],
}
# Labels that end a property's value only.
PROPERTY_ENDS = [
    r"Koku\s+eşiği", r"Odou?r\s+threshold", r"Buharlaşma\s+hızı", r"Evaporation\s+rate", r"Buhar\s+yoğunluğu", r"Vapou?r\s+density", r"Bölüntü\s+katsayısı", r"Partition\s+coefficient",
    r"Kendiliğinden\s+tutuşma\s+sıcaklığı", r"Otomatik\s+tutuşma\s+sıcaklığı", r"Auto[-\s]*ignition\s+temperature", r"Bozunma\s+sıcaklığı", r"Decomposition\s+temperature", r"Patlayıcı\s+sınırlar",
    r"Explosive\s+limits", r"Moleküler\s+ağırlık", r"Molecular\s+weight", r"Diğer\s+bilgiler", r"Other\s+information", r"Alev\s+Alma\s+Sıcaklığı", r"Tutuşma\s+sıcaklığı", r"Kısmi\s+Buhar\s+Basıncı",
    r"Partial\s+vapou?r\s+pressure", r"Molekül\s+Ağırlığı", r"Dağılım\s+katsayısı", r"Solvent\s*/\s*Alkol\s+Çözünürlüğü", r"Açıklamalar", r"Remarks?", r"Solvent\s+content", r"Organic\s+solvents?",
    r"Change\s+in\s+condition", r"Üst\s*/\s*Alt\s+Alevlenirlik\s+veya\s+patlayıcı\s+Limitleri", r"Alt\s*/\s*Üst\s+Alevlenirlik\s+veya\s+patlayıcı\s+Limitleri",
    r"Lower\s+and\s+upper\s+(?:explosion|flammability)\s+limits?", r"Upper\s+and\s+lower\s+(?:explosion|flammability)\s+limits?", r"9\.2\.?",
]
# Notes beside a property's value, and units of measured properties.
PROPERTY_NOTES = ["Hiçbiri bilinmiyor", "None known", "No method available"]
NO_VALUE_NOTES = [r"Bilgi\s+yok", r"Not\s+available", r"Not\s+determined"]
PROPERTY_TABLE_HEADINGS = [r"\bÖzellik\s+Değerler\s+Notlar\s*[•·]?\s*Yöntem\b", r"\bProperty\s+Values?\s+Remarks?\s+Method\b"]
PROPERTY_ECHOES = {"melting_freezing_point": r"Donma\s+noktası|Freezing\s+point", "boiling_point": r"Kaynama\s+aralığı|Boiling\s+range"}
#: A number with so few characters between it and a percent sign is no temperature.
NEAR_PERCENT = 3
#: Characters that a sentence about explosive properties has at least.
SPLIT_SENTENCE = 20
PRESSURE_UNITS = r"hPa|kPa|Pa|mbar|bar|mmHg"
DENSITY_UNITS = r"kg\s*/\s*l|g\s*/\s*ml|g\s*/\s*cm(?:3|³)|kg\s*/\s*m(?:3|³)"
VISCOSITY_UNITS = r"mPa\s*[·.]?\s*s|Pa\s*[·.]?\s*s|cP|cps|mm(?:2|²)\s*/\s*s|cSt"
# What shows that a value ran into another field, for every property and for single ones.
FOREIGN_MARKERS = ["güvenlik bilgi formu", "safety data sheet", "sayfa no:", "page no:", "düzenleme sayısı", "hazırlama tarihi", "printing date", "form no:", "www."]
FOREIGN_PROPERTY_MARKERS = {
    "melting_freezing_point": ["mmhg", "kaynama noktası", "boiling point", "alevlenebilirlik"],
    "boiling_point": ["mmhg", "alevlenebilirlik", "flammability", "parlama noktası", "flash point"],
    "flash_point": ["alev alma sıcaklığı", "tutuşma sıcaklığı", "auto-ignition", "buharlaşma hızı", "evaporation rate", "buhar basıncı", "vapour pressure", "vapor pressure"],
    "vapour_pressure": ["kısmi buhar basıncı", "partial vapour pressure", "buhar yoğunluğu", "vapour density", "vapor density", "bağıl yoğunluk", "relative density"],
    "density": ["çözünürlük", "solubility", "bölüntü katsayısı", "partition coefficient"],
    "viscosity": ["molekül ağırlığı", "molecular weight", "patlayıcılık", "explosive properties", "oksitleyici", "oxidising", "oxidizing"],
    "solubility": ["solvent/alkol çözünürlüğü", "dağılım katsayısı", "bölüntü katsayısı", "partition coefficient", "kendiliğinden tutuşma", "auto-ignition"],
    "explosive_properties": ["solvent content", "organic solvents", "change in condition"],
    "oxidising_properties": ["açıklamalar", "remarks"],
}
