"""English stop words (the long public list of the SMART retrieval system), by their endings."""

STOPWORDS = tuple(
    """
    a via b sub c inc etc d instead had described placed indeed need specified tried liked seemed ignored used
    indicated associated followed said did old could should would nd and beforehand behind second beyond around rd
    inward toward third ltd e be maybe twice hence thence whence since once aside beside outside three see he she the
    ie take like able available sensible possible while meanwhile whole example little me came became name same
    sometime come become welcome some nine one done someone gone alone none noone anyone everyone re are here there
    where somewhere elsewhere nowhere anywhere everywhere were before therefore more furthermore sure please these
    otherwise else those whose course use cause because indicate appreciate immediate appropriate despite quite value
    que have believe five above we f brief off if self himself herself yourself itself myself of g eg corresponding
    regarding according being seeing something nothing anything everything looking asking willing seeming becoming
    containing concerning doing going considering during using getting having following saying specifying trying
    along among h each which much inasmuch such though although enough through thorough oh wish th fifth with both
    forth i hi j k thank think ok look took ask l several novel until all shall overall tell well still will useful m
    am seem them him com whom from n an can mean than been seen between then when taken often gotten even seven given
    in again contain certain herein therein wherein within on non soon upon hereupon thereupon whereupon un own down
    known o co do go who hello no too zero so also to into onto unto two p uucp keep help up sup q r near appear far
    insofar particular consider wonder under her rather together whether either neither hither whither other another
    further former inner per later after hereafter thereafter whereafter latter better ever never whenever whoever
    wherever whatever however over moreover their or for nor our four your s as whereas has was needs tends regards
    downwards towards afterwards besides provides changes tries sometimes comes becomes ones does goes theres uses
    causes indicates gives selves themselves ourselves yourselves yes greetings is his this thanks looks seems
    happens contains perhaps keeps hers others theirs ours yours less regardless nevertheless unless across thats
    gets its wants us thus plus various serious vs allows follows knows says always anyways t at that what somewhat
    et get let yet eight might right ought it howbeit cant want different sent went got not cannot except kept apart
    least last best lest amongst against most almost first just must but out about throughout without next u edu you
    thru v qv w saw few new how somehow anyhow below allow now know x ex six thanx y okay may say way away anyway by
    hereby thereby whereby already somebody nobody anybody everybody they specify why probably presumably reasonably
    secondly hardly likely unlikely namely merely entirely lately unfortunately definitely relatively respectively
    accordingly thoroughly really especially normally usually actually hopefully awfully mainly certainly only
    clearly nearly particularly formerly latterly seriously obviously exactly currently consequently mostly truly my
    any many necessary very every sorry try z viz
    """.split()
)
