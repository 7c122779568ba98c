"""Term lists of claim frames, their checks and of memory, as data."""

# Word lists and weights that results depend on.

CORE_FIELDS = {"method": ["method"], "result": ["result_or_gain", "metric_or_signal", "dataset_or_setting"], "limitation": ["limitation", "problem"], "problem": ["problem"], "citation": ["short_claim"]}
FIELDS = {"short_claim": 2.0, "problem": 1.2, "method": 1.5, "dataset_or_setting": 1.0, "metric_or_signal": 1.0, "result_or_gain": 1.3, "limitation": 1.2}
SUPPORT = {"semantically_supported": (0.6, 0.6), "partially_supported": (0.25, 0.25), "related_only": (-0.5, -0.15), "insufficient_evidence": (-1.0, -0.3), "contradicted": (-2.0, -0.5)}
RISK = {"semantically_supported": "safe", "partially_supported": "needs_qualification", "related_only": "needs_more_evidence", "insufficient_evidence": "needs_more_evidence", "contradicted": "conflicting_evidence"}
WEAK_QUERY = ["局限", "不足", "风险", "缺口", "未支持", "unsupported", "验证", "证据", "warning", "噪声"]
CONFLICT = ["未验证", "未能", "没有", "无法", "不能", "不支持", "不足", "失败", "相反", "缺乏", "无显著", "受限", "局限", "风险", "not verified", "not support", "unsupported", "insufficient", "fail", "failed", "failure", "lack", "limited", "contradict"]
FAMILIES = {
    "llm_planning": ["大语言模型", "语言模型", "llm", "large language model", "prompt"],
    "multi_agent_planning": ["多智能体", "multi-agent", "multi agent", "协同规划", "协同调度"],
    "task_planning_framework": ["任务规划", "任务分解", "工具调用", "技能库", "规划框架"],
    "optimization_algorithm": ["优化", "调度", "负载均衡", "重分配", "算法"],
    "tree_search_rag": ["树检索", "tree search", "rag", "文档树"],
}
METRICS = ["任务完成率", "任务成功率", "成功率", "准确率", "召回率", "响应时间", "通信开销", "计算开销", "负载均衡", "鲁棒性", "accuracy", "recall", "latency", "score"]
NEGATIVE = ["不足", "失败", "不能", "未验证", "缺乏", "下降", "无显著", "低于"]
POSITIVE = ["提升", "提高", "优于", "改进", "增强", "降低响应", "减少开销", "减少"]
LOW_QUALITY, MIN_QUALITY = 0.55, 0.45
ALIGN = {"type": 0.25, "field": 0.30, "subject": 0.25, "family": 0.20}
ALIGN_THRESHOLD = 0.38
MEMORY_BONUS = {"project_rule": 0.35, "preference": 0.35, "task_progress": 0.25, "failure": 0.2}

# Terms that say nothing about a claim's support, and those too general to be specific hits.
SEMANTIC_STOP = ["本文", "研究", "提出", "方法", "模型", "系统", "算法", "实验", "结果", "表明", "采用", "通过", "基于", "实现", "问题", "相关", "进行", "具有", "paper", "method", "model", "system", "result", "study"]
GENERIC = ["任务", "务规", "规划", "务机", "器人", "智能", "能体", "任务规划", "服务", "机器人", "服务机器人", "智能体", "多智能体", "论文", "研究", "问题", "场景", "系统"]
