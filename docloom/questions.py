"""Questions that the registered queries ask besides the evaluation items."""

#: Questions of each intent and of several at once, with names of headings inside words and without any.
QUESTIONS = [
    "what commands do I need to run", "show me the values.yaml manifest", "expected output of the check", "which shell script starts it", "how do i follow the procedure", "prerequisites before installing",
    "Cluster", "install", "yaml and commands to deploy the gateway", "Storage layout", "what should I see after helm install", "zzqx vvkw", "", "verify the installation output of helm upgrade",
]
