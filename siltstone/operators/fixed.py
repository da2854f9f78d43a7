"""Fixed values of planning, reranking, selection, audits and screening: word lists and texts that results must equal."""

# Hints per category, in order of declaration.
CATEGORY_HINTS = {
    "RAG overview": ["rag", "retrieval augmented generation", "流程", "阶段", "架构", "2-step", "agentic", "hybrid", "知识库"],
    "RAG challenges": ["瓶颈", "难点", "挑战", "失败点", "局限", "限制", "failure point", "failure points", "limitation", "challenge", "lost in the middle"],
    "document loading": ["loader", "load", "加载", "读取", "解析", "document loader", "pdf", "网页"],
    "chunking": ["chunk", "split", "splitter", "切分", "分块", "固定窗口", "递归切分", "markdown", "标题"],
    "ingestion": ["ingestion", "pipeline", "入库", "摄取", "处理流水线", "transform", "node"],
    "indexing": ["index", "indexing", "索引", "建索引", "index structure"],
    "querying": ["query engine", "querying", "查询", "响应合成", "response synthesizer", "query rewrite", "query expansion", "query transformation", "查询改写", "查询扩展", "问题改写", "子问题", "多路查询"],
    "vector db": ["chroma", "vector", "向量库", "metadata", "collection", "filter", "过滤", "where"],
    "local model": ["ollama", "本地模型", "api", "generate", "chat", "qwen", "部署本地"],
    "embedding": ["embedding", "embed", "bge", "bge-m3", "sentence-bert", "向量化", "语义向量", "相似度"],
    "retrieval": ["retriever", "retrieve", "检索", "召回", "self-query", "metadata filter", "过滤检索", "hybrid search", "hybrid retrieval", "混合检索", "向量相似度", "vector search", "semantic search", "query rewrite", "query expansion"],
    "reranking": ["rerank", "reranker", "重排", "colbert", "late interaction", "候选排序"],
    "evaluation": ["eval", "evaluation", "评估", "忠实", "faithfulness", "groundedness", "correctness", "relevance", "命中率", "badcase"],
    "RAG paper": ["论文", "paper", "原始论文", "rag paper", "fever", "knowledge-intensive"],
}

# Words appended to a question when it is searched within a category.
CATEGORY_EXPANSIONS = {
    "RAG overview": "RAG stages architecture retrieval augmented generation loading indexing querying evaluation",
    "RAG challenges": "RAG failure points limitations challenges Missing Content Missed the Top Ranked Documents Not in Context Not Extracted Incorrect Specificity Incomplete hallucination retrieval errors lost in the middle robustness validation",
    "document loading": "document loaders readers parse files pdf html markdown data sources",
    "chunking": "text splitters chunks recursive splitter markdown structure-based splitting chunk size overlap",
    "ingestion": "ingestion pipeline transformations metadata nodes embeddings vector store",
    "indexing": "indexing vector index nodes embeddings store metadata",
    "querying": "query engine retriever response synthesizer sub query multi step hybrid query query rewrite query expansion query transformation query routing multi query sub-question",
    "vector db": "Chroma vector database collection metadata filter where embeddings document storage",
    "local model": "Ollama API generate chat embed local model Python client",
    "embedding": "embedding model BGE-M3 Sentence-BERT vector representations semantic retrieval",
    "retrieval": "retriever self query metadata filtering vector search hybrid search sparse dense retrieval strategy query rewrite query expansion",
    "reranking": "reranking reranker ColBERT late interaction candidate documents ranking",
    "evaluation": "RAG evaluation correctness relevance groundedness faithfulness retrieval relevance LLM as judge",
    "RAG paper": "Retrieval-Augmented Generation knowledge intensive NLP tasks RAG paper",
}

# Aspects in order: name -> (triggers, markers of the conservative planner, categories, search text).
ASPECTS = {
    "classification": (
        ["分类", "类别", "类型", "架构", "模式", "路线", "category", "categories", "type", "architecture"],
        ["分类", "架构类型", "架构模式", "范式", "2-step rag", "agentic rag", "hybrid rag"],
        ["RAG overview", "RAG paper"],
        "RAG architecture taxonomy paradigm 2-Step RAG Agentic RAG Hybrid RAG naive RAG advanced RAG modular RAG",
    ),
    "workflow": (
        ["流程", "阶段", "步骤", "怎么做", "实现", "pipeline", "workflow", "stage"],
        ["完整流程", "整体流程", "端到端流程", "rag workflow", "rag pipeline stages"],
        ["RAG overview", "ingestion", "indexing", "querying", "evaluation"],
        "RAG workflow ingestion loading chunking indexing retrieval context assembly response synthesis evaluation",
    ),
    "techniques": (
        ["关键技术", "技术", "组件", "模块", "能力", "technique", "component", "混合检索", "metadata", "过滤", "重排", "向量相似度", "hybrid", "rerank", "filter"],
        ["关键技术", "核心技术", "技术组件", "系统组件", "核心组件", "由哪些模块", "包含哪些模块"],
        ["document loading", "chunking", "embedding", "vector db", "retrieval", "reranking", "querying", "evaluation"],
        "RAG key components document parsing chunking embedding vector database hybrid retrieval reranking context assembly response synthesis evaluation",
    ),
    "query_optimization": (
        ["query rewrite", "query expansion", "query transformation", "rewrite", "expansion", "查询改写", "查询扩展", "问题改写", "多路查询", "子问题"],
        ["query rewrite", "query expansion", "query transformation", "查询改写", "查询扩展", "问题改写", "多路查询", "子问题"],
        ["querying", "retrieval", "RAG overview"],
        "RAG query optimization query rewrite query expansion query transformation query routing multi query sub-question retrieval recall ambiguous complex questions",
    ),
    "bottlenecks": (
        ["瓶颈", "难点", "挑战", "限制", "缺陷", "痛点", "bottleneck", "challenge", "limitation"],
        ["瓶颈", "难点", "挑战", "限制", "缺陷", "痛点", "bottleneck", "challenge", "limitation"],
        ["RAG challenges", "retrieval", "chunking", "embedding", "reranking", "evaluation", "vector db", "RAG overview"],
        "RAG bottlenecks challenges failure points Missing Content Missed the Top Ranked Documents Not in Context Not Extracted Incorrect Specificity Incomplete hallucination retrieval errors top K chunking embeddings reranking context token limit rate limit testing monitoring",
    ),
    "evaluation": (
        ["评估", "指标", "质量", "命中率", "忠实", "groundedness", "faithfulness", "eval", "metric"],
        ["评估", "指标", "忠实", "groundedness", "faithfulness", "evaluation", "metric"],
        ["evaluation", "retrieval"],
        "RAG evaluation metrics retrieval relevance faithfulness groundedness correctness citation quality citation recall citation precision badcase failure analysis diagnostic metrics claim-level context precision context recall context utilization hallucination noise sensitivity LLM as judge RAGChecker ALCE Ragas DeepEval Phoenix",
    ),
    "citation_quality": (
        ["citation", "cite", "source attribution", "attribution", "verifiability"],
        ["citation", "引用质量", "引用召回", "引用精度", "source attribution", "verifiability"],
        ["evaluation"],
        "ALCE citation quality citation recall citation precision cited passages supporting evidence verifiability attributable to identified sources NLI entailment citation evaluation",
    ),
    "badcase_analysis": (
        ["badcase", "failure analysis", "error analysis", "diagnostic"],
        ["badcase", "failure analysis", "error analysis", "diagnostic", "错误分析"],
        ["evaluation", "RAG challenges"],
        "RAGChecker diagnostic metrics failure analysis badcase sources of errors claim-level retriever metrics generator metrics context utilization noise sensitivity hallucination self-knowledge faithfulness",
    ),
}
# Order in which the conservative planner looks for aspects.
CONSERVATIVE_ORDER = ["workflow", "classification", "techniques", "query_optimization", "bottlenecks", "evaluation", "citation_quality", "badcase_analysis"]
# Markers under which an evaluation question also needs these.
CITATION_MARKERS = ["citation", "cite", "source attribution", "attribution", "verifiability", "badcase", "metric", "指标"]
# What a broad question is about.
BROAD_SUBJECTS = ["rag", "检索增强", "知识库"]
# How a broad question asks.
BROAD_MARKERS = ["介绍", "概览", "系统", "整体", "完整", "有哪些", "是什么", "overview"]
# Questions about ingestion.
INGESTION_SCOPE = ["ingestion", "摄取", "入库", "知识库更新", "增量更新", "向量写入"]
# Questions about identity in ingestion.
INGESTION_IDENTITY = ["幂等", "重复", "去重", "文档id", "document id", "旧向量", "一致性", "过期"]
# Questions about caches in ingestion.
INGESTION_CACHE = ["缓存", "cache"]
# Search text of ingestion identity.
IDENTITY_SEARCH = "ingestion pipeline document ID idempotency deduplication update delete stale vectors vector store consistency"
# Search text of ingestion caches.
CACHE_SEARCH = "ingestion pipeline cache invalidation document update transformation cache clear stale processing results"
# What the techniques aspect becomes for narrower questions.
TECHNIQUES_METADATA = (["vector db", "retrieval", "ingestion"], "Chroma vector database collection metadata filter where embeddings document storage retrieval RAG")
TECHNIQUES_RERANK = (["reranking", "retrieval", "embedding", "RAG overview"], "RAG reranking reranker candidate documents semantic search dense retrieval cross encoder relationship vector retrieval")
TECHNIQUES_HYBRID = (["retrieval", "vector db", "embedding", "reranking", "RAG challenges"], "enterprise RAG hybrid retrieval metadata filtering reranking vector similarity search BGE-M3 dense sparse retrieval re-ranking failure precision recall")
# Intents by first match.
INTENTS = [
    ("explain", ["怎么", "如何", "why", "为什么", "原理"]),
    ("compare", ["比较", "区别", "vs", "对比"]),
    ("how_to", ["步骤", "流程", "怎么做", "实现"]),
    ("evaluate", ["evaluation", "评估"]),
]

# Aliases of search terms.
TERM_ALIASES = {
    "rag": ["retrieval", "augmented", "generation", "retrieval-augmented"],
    "检索增强": ["rag", "retrieval", "augmented", "generation"],
    "切分": ["chunk", "chunks", "chunking", "split", "splitter", "splitting"],
    "分块": ["chunk", "chunks", "chunking", "split", "splitter", "splitting"],
    "固定窗口": ["fixed", "window", "chunk_size", "chunk size", "fixed chunk size"],
    "边界": ["boundary", "boundaries", "sentence", "paragraph", "section", "heading"],
    "重排": ["rerank", "reranker", "reranking", "ranker", "postprocessor"],
    "召回": ["retrieve", "retrieval", "retriever", "candidate", "candidates"],
    "向量": ["vector", "embedding", "embeddings", "dense"],
    "评估": ["evaluation", "evaluate", "faithfulness", "groundedness", "relevance"],
    "元数据": ["metadata", "filter", "where"],
    "过滤": ["filter", "metadata", "where"],
    "上下文": ["context", "window", "synthesis"],
}

# Evidence terms per aspect.
EVIDENCE_TERMS = {
    "bottlenecks": ["failure points of rag systems", "missing content", "missed the top ranked documents", "not in context", "not extracted", "incorrect specificity", "incomplete", "token limit", "rate limit", "hallucinations", "robustness", "testing and monitoring"],
    "techniques": ["chunking", "embedding", "retrieval strategy", "rerank", "metadata", "query process", "evaluation"],
    "query_optimization": ["query rewrite", "query expansion", "query transformation", "query routing", "multi query", "sub-question", "sub query", "ambiguous", "complex", "retrieval validation", "query enhancement", "recall"],
    "classification": ["naive rag", "advanced rag", "modular rag", "2-step rag", "agentic rag", "hybrid rag", "paradigm", "architecture"],
    "evaluation": ["citation quality", "citation recall", "citation precision", "claim-level", "diagnostic metrics", "context precision", "context recall", "context utilization", "contextual precision", "contextual recall", "document relevance", "faithfulness", "groundedness", "hallucination", "noise sensitivity", "badcase", "failure analysis", "ragchecker", "alce"],
    "citation_quality": ["citation quality", "citation recall", "citation precision", "cited passages", "supporting evidence", "verifiability", "attributable", "nli model", "entails", "supported by cited passages", "alce"],
    "badcase_analysis": ["diagnostic metrics", "claim-level", "sources of errors", "retriever metrics", "generator metrics", "context utilization", "noise sensitivity", "hallucination", "failure analysis", "badcase", "ragchecker"],
}
# Sources an aspect should have, and the order in which categories are covered.
LEAST_SOURCES = {"classification": 2, "query_optimization": 2, "evaluation": 3, "citation_quality": 2, "badcase_analysis": 2}
CATEGORY_PRIORITY = ["RAG challenges", "chunking", "embedding", "retrieval", "reranking", "evaluation", "querying", "vector db", "document loading", "indexing", "ingestion", "RAG overview", "RAG paper"]

# Keywords by which an answer covers an aspect.
ASPECT_KEYWORDS = {
    "classification": ["分类", "类别", "类型", "架构", "2-step", "agentic", "hybrid", "naive", "advanced"],
    "workflow": ["流程", "阶段", "接入", "切分", "索引", "检索", "生成", "评估"],
    "techniques": ["关键技术", "文档", "解析", "chunk", "切分", "embedding", "向量", "检索", "重排", "上下文", "评估"],
    "query_optimization": ["query rewrite", "query expansion", "改写", "扩展", "查询", "召回", "检索", "复杂", "模糊", "子问题"],
    "bottlenecks": ["瓶颈", "挑战", "难点", "召回", "噪声", "幻觉", "延迟", "成本", "更新", "权限", "引用"],
    "evaluation": ["评估", "指标", "相关性", "忠实", "正确性", "引用", "badcase", "judge"],
    "citation_quality": ["引用质量", "引用召回", "引用精度", "支撑", "可验证", "citation", "precision", "recall"],
    "badcase_analysis": ["badcase", "诊断", "检索错误", "生成错误", "上下文利用", "噪声", "幻觉", "failure", "error"],
}

# Patterns of the request and evidence screens.
INJECTION = [
    r"ignore\s+(?:all\s+)?(?:previous|prior|system|developer)\s+instructions?",
    r"override\s+(?:the\s+)?(?:system|developer)\s+(?:prompt|message|instructions?)",
    r"忽略.{0,12}(?:之前|此前|上面|系统|开发者).{0,8}(?:指令|规则|提示词)",
    r"(?:绕过|越过|覆盖).{0,10}(?:系统|安全|权限).{0,8}(?:规则|限制|指令)",
    r"你现在是.{0,30}(?:不受限制|无视规则|开发者模式)",
]
SECRET_REQUESTS = [
    r"(?:显示|输出|告诉我|给我|读取|打印|返回|列出).{0,20}(?:api[ _-]?key|token|密钥|\.env|环境变量|系统提示词|内部配置)",
    r"(?:show|reveal|print|dump|return|list|read).{0,20}(?:api[ _-]?key|token|secret|\.env|environment variable|system prompt)",
]
FOREIGN_MEMORY = [
    r"(?:显示|输出|告诉我|读取|列出|查看).{0,15}(?:其他|别的|所有).{0,8}用户.{0,12}(?:记忆|对话|会话|历史)",
    r"(?:show|reveal|read|list).{0,20}(?:another|other|all) users?.{0,15}(?:memory|conversation|history|session)",
]
EDUCATIONAL = ["如何防御", "怎么防止", "如何防止", "什么是", "原理", "最佳实践", "如何检测", "如何评估", "防护", "how to defend", "how to prevent", "what is", "best practice"]
POLICY_MARKERS = ["rag", "知识库", "拒答", "安全边界", "知识边界", "资料不足"]
OUTSIDE = [
    ("live_weather", ["天气", "气温", "降雨", "weather", "temperature"], ["今天", "明天", "当前", "现在", "实时", "today", "tomorrow", "current", "live"]),
    ("live_financial_data", ["股价", "股票价格", "汇率", "币价", "stock price", "exchange rate", "crypto price"], ["今天", "当前", "现在", "实时", "最新", "today", "current", "live", "latest"]),
    ("live_sports_or_news", ["比分", "赛果", "实时新闻", "score", "breaking news"], ["今天", "当前", "现在", "实时", "最新", "today", "current", "live", "latest"]),
]
EVIDENCE_INJECTION = [
    r"ignore\s+(?:all\s+)?(?:previous|prior|system)\s+instructions?",
    r"忽略.{0,12}(?:之前|上面|系统).{0,8}(?:指令|规则|提示词)",
    r"(?:reveal|print|输出|显示).{0,15}(?:secret|api[ _-]?key|token|密钥|系统提示词)",
    r"(?:调用工具|执行命令|进入开发者模式|developer mode)",
]
# Words of conversation memory.
REFERRING = ["这个", "上面", "刚才", "继续", "下一步", "它"]
MEMORY_QUESTIONS = ["我之前", "刚才", "上次", "之前说", "记得", "偏好", "要求", "我们之前", "项目进展", "做到哪", "进行到哪", "接下来", "下一步"]
WISHES = ["我希望", "我想", "我需要", "不要", "不想", "每天", "后面", "以后", "作品集", "github", "项目", "学习"]
PREFERENCES = ["我希望", "不要", "不想", "每天", "学习"]
PROJECT_WORDS = ["继续", "下一步", "现在", "项目", "RAG", "网页", "长记忆"]

# How a prompt opens and closes the list of what an answer must cover.
REQUIREMENTS = ("本轮问题需要覆盖这些子问题：", "如果某个子问题没有足够检索资料支持，请在答案中明确说明资料不足。")
