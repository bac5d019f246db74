"""Fixed values that results depend on: published scales, masses, label tables and texts."""

# Average masses of deoxynucleotides (monophosphates) and of water, in dalton.
DNA_MASS = {"A": 331.2218, "C": 307.1971, "G": 347.2212, "T": 322.2085}
WATER = 18.0153

# Average masses of the free amino acids, in dalton.
RESIDUE_MASS = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546,
    "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445,
    "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}

# Hydropathy index (Kyte and Doolittle 1982).
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}

# Normalised flexibility (Vihinen et al. 1994); weights from the window's ends to its middle.
FLEXIBILITY = {
    "A": 0.984, "C": 0.906, "D": 1.068, "E": 1.094, "F": 0.915, "G": 1.031, "H": 0.950, "I": 0.927, "K": 1.102, "L": 0.935,
    "M": 0.952, "N": 1.048, "P": 1.049, "Q": 1.037, "R": 1.008, "S": 1.046, "T": 0.997, "V": 0.931, "W": 0.904, "Y": 0.929,
}
FLEXIBILITY_WEIGHTS = (0.25, 0.4375, 0.625, 0.8125, 1.0)

# pK of ionising groups (Bjellqvist et al. 1993), charge when ionised.
PK = (("N-term", 7.5, 1), ("K", 10.0, 1), ("R", 12.0, 1), ("H", 5.98, 1), ("C-term", 3.55, -1), ("D", 4.05, -1), ("E", 4.45, -1), ("C", 9.0, -1), ("Y", 10.0, -1))

# The standard genetic code, codons in the order of the letters TCAG.
CODE_LETTERS = "TCAG"
CODE_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Task states, roles and permissions.
STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
ROLES = ("user", "manager", "admin")
PERMISSIONS = {
    "user": ("task:submit", "task:view:own", "task:delete:own", "queue:view", "apikey:create", "apikey:list:own"),
    "manager": (
        "task:submit", "task:view:all", "task:delete:own", "queue:view", "user:list", "apikey:create", "apikey:delete", "apikey:list:own", "system:stats",
    ),
    "admin": (
        "task:submit", "task:view:own", "task:view:all", "task:delete:own", "task:delete:all", "queue:view", "queue:manage", "user:create", "user:update",
        "user:delete", "user:list", "apikey:create", "apikey:delete", "apikey:list:own", "apikey:list:all", "system:config", "system:stats",
    ),
}

# File extensions of each engine; the two sequence formats are registered first.
ENGINES = {
    "fasta": (".fasta", ".fa", ".fna", ".ffn", ".faa", ".frn", ".fas"),
    "genbank": (".gb", ".gbk", ".genbank", ".gbff"),
    "sensevoice": (".wav", ".mp3", ".flac", ".m4a", ".ogg"),
    "video": (".mp4", ".avi", ".mkv", ".mov", ".flv", ".wmv"),
    "pipeline": (".pdf", ".png", ".jpg", ".jpeg"),
    "markitdown": (".docx", ".xlsx", ".pptx", ".doc", ".xls", ".ppt", ".html", ".txt", ".csv"),
}
# Category, shown name and description of the engines.
ENGINE_INFO = {
    "pipeline": ("document", "MinerU Pipeline", "默认的 PDF/图片解析引擎，支持公式、表格等复杂结构"),
    "markitdown": ("office", "MarkItDown", "Office 文档和文本文件转换引擎"),
    "paddleocr_vl": ("ocr", "PaddleOCR-VL", "PaddlePaddle 视觉语言 OCR 引擎"),
    "sensevoice": ("audio", "SenseVoice", "语音识别引擎，支持多语言自动检测"),
    "video": ("video", "Video Processing", "视频处理引擎，支持关键帧提取和音频转录"),
    "fasta": ("format", "FASTA", "生物序列格式 (DNA/RNA/蛋白质)"),
    "genbank": ("format", "GENBANK", "GenBank 注释序列格式"),
}
EXPLICIT_BACKENDS = ("sensevoice", "video", "paddleocr-vl", "pipeline")

# Transcript tags and their symbols.
LANGUAGE_TAGS = ("zh", "en", "ja", "ko", "yue")
EMOTIONS = {"NEUTRAL": "😐", "HAPPY": "😊", "ANGRY": "😠", "SAD": "😢"}
EVENTS = {"Speech": "💬", "Applause": "👏", "BGM": "🎵", "Laugh": "😄"}

# Names of the processing backends.
BACKEND_LABELS = {"pipeline": "Document pipeline", "paddleocr-vl": "PaddleOCR-VL", "vlm-transformers": "VLM Transformers", "vlm-vllm-engine": "VLM vLLM Engine"}

# Sentences of the descriptions, with format() fields.
NUCLEOTIDE_TEXT = {
    "en": {
        "gc_lowest": "This is an extremely AT-rich sequence (GC content %.1f%%), possibly from parasitic organisms or extremophiles",
        "gc_low": "This is an AT-rich sequence (GC content %.1f%%), likely from AT-rich genomic regions",
        "gc_highest": "This is an extremely GC-rich sequence (GC content %.1f%%), common in actinomycetes or certain plant genomes",
        "gc_high": "This is a GC-rich sequence (GC content %.1f%%), potentially encoding structural genes or promoter regions",
        "gc_middle": "This sequence has moderate GC content (%.1f%%)",
        "skew": "Significant GC skew (%.2f, %s), may indicate replication origin or strand bias",
        "positive": "positive",
        "negative": "negative",
        "orf_longest": "Long open reading frame detected (%d bp), highly likely to encode a large protein or gene",
        "orf_long": "Long open reading frame detected (%d bp), potentially encoding a functional protein",
        "orf_many": "Total %d ORFs detected, may contain multiple genes or operons",
        "orf_middle": "Contains a moderate-length open reading frame (%d bp)",
        "cpg_many": "Multiple CpG islands detected (%d), strong indication of gene promoter regions or CGI shores",
        "cpg": "Identified %d CpG island(s), potentially associated with gene regulation",
        "repeats_many": "Numerous repeat sequences found (%d), possibly satellite DNA, microsatellites, or transposable elements",
        "repeats": "Found %d repeat sequence(s), possibly with structural or regulatory functions",
        "complexity_lowest": "Extremely low sequence complexity, likely homopolymer or simple repeat",
        "complexity_low": "Low sequence complexity, likely a simple repeat or low-complexity region",
        "complexity_high": "High sequence complexity with rich information content",
        "separator": "; ",
        "end": ".",
    },
    "zh": {
        "gc_lowest": "该序列为极低 GC 序列（GC含量 %.1f%%），可能来自寄生生物或极端环境微生物",
        "gc_low": "该序列为 AT 富集序列（GC含量 %.1f%%），可能来自 AT 富集的基因组区域",
        "gc_highest": "该序列为极高 GC 序列（GC含量 %.1f%%），常见于放线菌或某些植物基因组",
        "gc_high": "该序列为 GC 富集序列（GC含量 %.1f%%），可能编码结构基因或启动子区域",
        "gc_middle": "该序列具有中等 GC 含量（%.1f%%）",
        "skew": "GC 偏斜度显著（%.2f，%s），可能指示 DNA 复制起点或链特异性",
        "positive": "正向",
        "negative": "负向",
        "orf_longest": "检测到长开放阅读框（%d bp），高度可能编码大型蛋白质或基因",
        "orf_long": "检测到长开放阅读框（%d bp），可能编码功能蛋白",
        "orf_many": "共检测到 %d 个 ORF，可能包含多个基因或操纵子",
        "orf_middle": "包含中等长度的开放阅读框（%d bp）",
        "cpg_many": "检测到多个 CpG 岛（%d 个），高度提示基因启动子区域或 CpG 岛岸区",
        "cpg": "检测到 %d 个 CpG 岛，可能与基因调控相关",
        "repeats_many": "发现大量重复序列（%d 处），可能为卫星 DNA、微卫星或转座子元件",
        "repeats": "发现 %d 处重复序列，可能具有结构或调控功能",
        "complexity_lowest": "序列复杂度极低，可能为同聚物或简单重复序列",
        "complexity_low": "序列复杂度较低，可能为简单重复或低复杂度区域",
        "complexity_high": "序列复杂度高，信息含量丰富",
        "separator": "；",
        "end": "。",
    },
}
SUMMARY_TEXT = {
    "en": {"empty": "Empty file, no sequences found", "some": "Contains %d biological sequence(s), total length %s bp"},
    "zh": {"empty": "空文件，未找到任何序列", "some": "包含 %d 条生物序列，总长度 %s bp"},
}

PROTEIN_TEXT = {
    "en": {
        "mass_large": "Large protein, molecular weight %.1f kDa", "mass_small": "Small peptide, molecular weight %.1f kDa", "mass": "Molecular weight %.1f kDa",
        "stable_very": "Highly stable (instability index %.1f), suitable for in vitro expression and purification",
        "stable": "This protein is predicted to be stable (instability index %.1f)",
        "unstable": "Unstable (instability index %.1f), may require special handling or rapid processing",
        "pi_lowest": "Strong acidic protein (pI %.2f), likely rich in aspartic and glutamic acids", "pi_low": "Isoelectric point %.2f, acidic protein",
        "pi_highest": "Strong basic protein (pI %.2f), likely rich in lysine and arginine", "pi_high": "Isoelectric point %.2f, basic protein",
        "pi_middle": "Isoelectric point %.2f, neutral protein",
        "gravy_highest": "Highly hydrophobic protein (GRAVY %.2f), very likely transmembrane or membrane-associated protein",
        "gravy_high": "GRAVY score %.2f, hydrophobic protein, likely a membrane protein",
        "gravy_lowest": "Highly hydrophilic protein (GRAVY %.2f), possibly secreted or extracellular protein", "gravy_low": "GRAVY score %.2f, hydrophilic protein",
        "helix_rich": "Rich in α-helix (%.1f%%), possibly helical bundle or DNA-binding protein", "sheet_rich": "Rich in β-sheet (%.1f%%), possibly β-barrel or amyloid protein",
        "structure": "Secondary structure prediction: α-helix %.1f%%, β-sheet %.1f%%", "aromatic": "High aromaticity (%.1f%%), may contain important aromatic residue clusters",
        "phospho_many": "Numerous phosphorylation sites detected (%d), may be extensively regulated by phosphorylation",
        "phospho": "Identified %d potential phosphorylation site(s)", "glyco": "Contains %d N-glycosylation site(s), may be a glycoprotein",
        "separator": "; ", "end": ".",
    },
    "zh": {
        "mass_large": "大型蛋白质，分子量 %.1f kDa", "mass_small": "小分子多肽，分子量 %.1f kDa", "mass": "分子量 %.1f kDa",
        "stable_very": "高度稳定（不稳定指数 %.1f），适合体外表达和纯化", "stable": "该蛋白质预测为 stable（不稳定指数 %.1f）",
        "unstable": "不稳定（不稳定指数 %.1f），可能需要特殊处理或快速处理",
        "pi_lowest": "强酸性蛋白（等电点 %.2f），可能富含天冬氨酸和谷氨酸", "pi_low": "等电点 %.2f，为酸性蛋白",
        "pi_highest": "强碱性蛋白（等电点 %.2f），可能富含赖氨酸和精氨酸", "pi_high": "等电点 %.2f，为碱性蛋白", "pi_middle": "等电点 %.2f，为中性蛋白",
        "gravy_highest": "高度疏水性蛋白（GRAVY %.2f），很可能为跨膜蛋白或膜结合蛋白", "gravy_high": "GRAVY 值 %.2f，为疏水性蛋白，可能为膜蛋白",
        "gravy_lowest": "高度亲水性蛋白（GRAVY %.2f），可能为分泌蛋白或细胞外蛋白", "gravy_low": "GRAVY 值 %.2f，为亲水性蛋白",
        "helix_rich": "富含 α-螺旋（%.1f%%），可能为螺旋束蛋白或 DNA 结合蛋白", "sheet_rich": "富含 β-折叠（%.1f%%），可能为 β-桶状蛋白或淀粉样蛋白",
        "structure": "二级结构预测：α-螺旋 %.1f%%，β-折叠 %.1f%%", "aromatic": "高芳香性（%.1f%%），可能包含重要的芳香族残基簇",
        "phospho_many": "检测到大量磷酸化位点（%d 个），可能受到广泛的磷酸化调控", "phospho": "检测到 %d 个潜在磷酸化位点", "glyco": "包含 %d 个 N-糖基化位点，可能为糖蛋白",
        "separator": "；", "end": "。",
    },
}

RECORD_TEXT = {
    "en": {
        "organism": "This sequence is from %s", "length_gc": "Total length %s bp, GC content %.1f%%", "length": "Total length %s bp", "genes": "Contains %d gene(s) and %d coding sequence(s)",
        "products": "Main encoded proteins include: %s", "rna": "Contains RNA features: %s", "regulatory": "Contains %d regulatory element(s)", "taxonomy": "Taxonomy: %s",
        "references": "Contains %d reference(s)", "separator": "; ", "end": ".",
    },
    "zh": {
        "organism": "该序列来自 %s", "length_gc": "全长 %s bp，GC 含量 %.1f%%", "length": "全长 %s bp", "genes": "包含 %d 个基因和 %d 个编码序列",
        "products": "编码的主要蛋白质包括：%s", "rna": "包含 RNA 特征：%s", "regulatory": "包含 %d 个调控元件", "taxonomy": "分类学：%s",
        "references": "包含 %d 篇参考文献", "separator": "；", "end": "。",
    },
}

# Labels of the sequence reports.
REPORT_TEXT = {
    "en": {
        "title": "FASTA Sequence Analysis Results", "statistics": "Statistics", "count": "Sequence Count", "total": "Total Length", "average": "Average Length", "shortest": "Shortest Sequence",
        "longest": "Longest Sequence", "details": "Sequence Details", "meaning": "Biological Significance", "preview": "Sequence Preview", "gc": "GC Content", "orf": "Longest ORF",
        "cpg": "CpG Islands", "complexity": "Sequence Complexity", "weight": "Molecular Weight", "pi": "Isoelectric Point", "stability": "Stability", "gravy": "Hydropathy (GRAVY)",
        "structure": "Secondary Structure Prediction",
    },
    "zh": {
        "title": "FASTA 序列解析结果", "statistics": "统计信息", "count": "序列数量", "total": "总长度", "average": "平均长度", "shortest": "最短序列",
        "longest": "最长序列", "details": "序列详情", "meaning": "生物学意义", "preview": "序列预览", "gc": "GC 含量", "orf": "最长 ORF",
        "cpg": "CpG 岛数量", "complexity": "序列复杂度", "weight": "分子量", "pi": "等电点", "stability": "稳定性", "gravy": "疏水性 (GRAVY)",
        "structure": "二级结构预测",
    },
}

# Title of a report on annotated records.
RECORD_TITLE = {"en": "GenBank Sequence Analysis Results", "zh": "GenBank 序列解析结果"}
