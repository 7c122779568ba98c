"""Term lists, weights and thresholds, as data.

Callers pass their own lists where an operator takes one; these are defaults.
"""

from __future__ import annotations

# Word lists, patterns and numbers that results depend on.

CJK = r"[\u4e00-\u9fff]"
TERM = r"[A-Za-z][A-Za-z0-9_-]{2,}|[\u4e00-\u9fff]{2,}"
EMBEDDING_TOKEN = r"[a-z][a-z0-9_-]{1,}|[\u4e00-\u9fff]{2,}"

SEARCH_PHRASES = ["主要研究内容", "研究内容", "主要贡献", "研究背景", "研究目的", "任务规划", "任务分配", "参考文献", "关键词", "摘要", "结论"]
SEARCH_STOP = ["这篇", "论文", "什么", "是什么", "主要", "研究"]
FOCUS_PHRASES = ["主要研究内容", "研究内容", "主要贡献", "研究背景", "研究目的", "任务规划", "任务分配", "协同调度", "动态角色", "参考文献", "关键词", "摘要", "结论", "局限", "实验结果"]
FOCUS_STOP = ["这篇", "论文", "什么", "是什么", "主要", "研究", "内容", "一下", "进行", "哪些", "the", "does", "what", "which", "paper", "use", "uses", "used"]
KEYWORD_STOP = ["the", "and", "for", "with", "from", "this", "that", "are", "was", "into", "about", "研究", "系统", "方法", "问题", "分析"]

INTENT_PRIORITY = ["compare", "review", "citation", "limitation", "experiment", "method"]
INTENT_TRIGGERS = {
    "method": ["方法", "算法", "模型", "框架", "机制", "流程", "设计", "怎么做", "如何实现", "method", "algorithm", "model", "framework", "design"],
    "experiment": ["实验", "评测", "评价", "指标", "结果", "基线", "数据集", "消融", "experiment", "evaluation", "result", "metric", "baseline"],
    "limitation": ["局限", "不足", "限制", "失败", "未来工作", "展望", "问题", "limitation", "weakness", "future work"],
    "citation": ["引用", "参考文献", "文献", "来源", "cite", "citation", "reference"],
    "compare": ["比较", "对比", "区别", "差异", "异同", "相同", "不同", "compare", "comparison", "difference"],
    "review": ["综述", "研究现状", "进展", "梳理", "总结", "归纳", "路线", "survey", "review", "overview"],
}
INTENT_NODE_TYPES = {
    "method": ["section", "paragraph", "abstract"],
    "experiment": ["section", "paragraph", "table", "figure"],
    "limitation": ["section", "paragraph"],
    "citation": ["reference", "paragraph", "section"],
    "compare": ["section", "paragraph", "abstract"],
    "review": ["abstract", "section", "paragraph"],
    "qa": ["abstract", "section", "paragraph"],
}
INTENT_SECTIONS = {
    "method": ["方法", "算法", "模型", "框架", "研究内容", "主要贡献", "系统设计", "method", "algorithm", "model", "framework"],
    "experiment": ["实验", "评测", "结果", "数据", "指标", "验证", "experiment", "evaluation", "result"],
    "limitation": ["局限", "不足", "讨论", "结论", "展望", "未来工作", "limitation", "discussion", "conclusion"],
    "citation": ["参考文献", "相关工作", "引用", "文献"],
    "compare": ["方法", "实验", "结果", "结论", "贡献", "局限", "method", "experiment", "result", "conclusion"],
    "review": ["摘要", "绪论", "相关工作", "方法", "结论", "展望", "abstract", "introduction", "related work", "method"],
    "qa": ["摘要", "研究内容", "方法", "结论"],
}
METRIC_WORDS = ["指标", "数值", "成功率", "准确率", "召回率", "表格", "表 ", "table", "metric", "score", "%"]
#: intent -> (name, lexical weight, vector weight)
FUSION_WEIGHTS = {"citation": ("fts_reference_boost", 1.25, 0.75), "metric": ("fts_metric_boost", 1.15, 0.85), "semantic": ("semantic_vector_boost", 0.85, 1.15)}
FUSION_K = 60.0
FRONT_MATTER = ["目录", "学院", "专业", "研究生", "指导教师", "答辩", "分类号", "学号", "密级", "网络首发", "收稿日期", "引用格式", "出版确认", "doi", "issn"]
REFERENCE_WORDS = ["参考", "引用", "reference"]
ROUTING_WEIGHTS = {"title": 3.0, "abstract": 2.5, "keywords": 2.0, "description": 1.6, "method_summary": 1.4, "innovation_summary": 1.2, "limitation_summary": 1.0}

NOISE_MARKERS = ["网络首发", "引用格式", "issn", "cn ", "journal of", "中图分类号", "文献标志码", "收稿日期", "基金项目", "资助", "版权所有", "copyright", "http://", "https://", "www.", "doi", "分类号", "学号", "密级", "作者简介", "通信作者"]
RESEARCH_SIGNALS = ["提出", "方法", "算法", "模型", "框架", "机制", "系统", "实验", "结果", "验证", "提升", "降低", "优于", "局限", "不足", "任务规划", "多智能体", "服务机器人", "dataset", "method", "model", "framework", "experiment", "result", "limitation"]

BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
HASH_DIM = 256
